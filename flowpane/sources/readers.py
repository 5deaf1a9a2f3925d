"""Readers: flow CSV files with or without a header, clean Parquet, feature lists."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowpane.functions import vocabulary as V


def headerless_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in V.HEADERLESS_COLUMNS])


def _header_names(line: str) -> list[str]:
    """Column names of a header line; a repeated name gets .1, .2 and so on."""
    names, met = [], {}
    for name in next(csv.reader([line.removeprefix("\xef\xbb\xbf")]), []):
        name = name.strip()
        met[name] = met.get(name, -1) + 1
        names.append(f"{name}.{met[name]}" if met[name] else name)
    return names


#: Jobs that read first lines at the same time.
HEADER_JOBS = 16


def list_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The data files under ``path``, by any path that Spark can read; no file is opened."""
    paths = [path] if isinstance(path, str) else list(path)
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").collect())


def _pattern_safe(file: str) -> str:
    """A file name as the pattern that only it matches."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", file)


def first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is not blank; a job with one task that stops there, so a few kilobytes are read."""
    lines = (spark.read.option("encoding", "ISO-8859-1").option("sep", chr(1)).option("quote", "").schema("line string").csv(_pattern_safe(file)))
    found = lines.where(F.length(F.trim("line")) > 0).head(1)
    return found[0]["line"] if found else None


def files_by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """The files of ``path`` (as patterns) by their first line that is not blank; files without one are left out, as they
    have no rows. One name and one line per file come to the driver."""
    files = list_files(spark, path)
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    found: dict[str, list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is not None:
            found.setdefault(line, []).append(_pattern_safe(file))
    return found


def read_flows(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
               tag: str | None = "source") -> DataFrame:
    """Flow CSVs as text columns: one dirty cell must not decide a column's type, and no inference pass is run.

    Without ``schema`` the files have a header, each its own: files are read under their own header and united by column
    name, so order and spelling may differ between files; a column that a file lacks is null. ``tag`` names a column that
    receives the file name.
    """
    reader = (spark.read.option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", True)
              .option("mode", "PERMISSIVE"))
    tagged = lambda df: df.withColumn(tag, F.col("_metadata.file_name")) if tag else df
    if schema is not None:
        return tagged(reader.schema(schema).option("header", False).csv(path))
    groups = files_by_header(spark, path)
    if not groups:
        df = reader.option("header", True).option("inferSchema", False).csv(path)
        return tagged(df.toDF(*[c.strip() for c in df.columns]))
    parts = [tagged(reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in _header_names(line)]))
                    .option("header", True).csv(files)) for line, files in sorted(groups.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_clean(spark: SparkSession, path: str, source: str = "source") -> DataFrame:
    """Clean Parquet; a source named like a date or a number stays text."""
    df = spark.read.parquet(path)
    return df.withColumn(source, F.col(source).cast("string")) if source in df.columns else df


def union_sources(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All tables in one, each row tagged with the name of the table it came from; absent columns become null."""
    tagged = [d.withColumn(tag, F.lit(name)) for name, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, feature): one name per line, blank lines ignored; ``line`` keeps the order of the file."""
    return (spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
            .select("line", F.trim("value").alias("feature")).where(F.length("feature") > 0))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Univariate series files: (series_id, t, value, ...)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = [F.col(c).try_cast("double").alias(c) for c in raw.columns if c != "time_step"]
    return raw.select(F.col("_metadata.file_name").alias("series_id"), F.col("time_step").try_cast("int").alias("t"),
                      *cols)
