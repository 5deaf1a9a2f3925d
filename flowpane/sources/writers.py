"""Writers: clean tables, class extracts, window sets, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.functions import labels as L


def write_clean(df: DataFrame, path: str, mode: str = "errorifexists", source: str = "source") -> None:
    df.write.mode(mode).partitionBy(source).parquet(path)


def write_by_class(df: DataFrame, path: str, label: str = "label", mode: str = "errorifexists") -> None:
    """One table partitioned by ``is_malicious``: reading all, the benign or the malicious part prunes folders."""
    df.withColumn("is_malicious", L.is_malicious(F.col(label))).write.mode(mode).partitionBy("is_malicious").parquet(path)


def write_windows(windows: DataFrame, meta: DataFrame, catalog: DataFrame, path: str, source: str = "source",
                  mode: str = "errorifexists") -> None:
    windows.write.mode(mode).partitionBy(source).parquet(f"{path}/windows")
    meta.write.mode(mode).parquet(f"{path}/window_meta")
    catalog.write.mode(mode).parquet(f"{path}/feature_catalog")


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Scores and reports as CSV (with header) or JSON lines."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
