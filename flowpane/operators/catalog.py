"""Feature catalogue: which features exist, which are common to all sources, what was found and what is missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowpane.functions import numbers as N


def numeric_text_features(df: DataFrame, candidates: Sequence[str], by: str) -> DataFrame:
    """(feature, sources, total_sources, is_common): a feature is common when, in every source, each non-null
    value reads as a number. One pass over the table for all features."""
    bad = [F.count_if(F.col(f"`{c}`").isNotNull() & N.to_number(F.col(f"`{c}`")).isNull()).alias(c)
           for c in candidates]
    per = df.groupBy(by).agg(*bad)
    tall = per.unpivot([by], list(candidates), "feature", "bad")
    return tall.groupBy("feature").agg(
        F.count_if(F.col("bad") == 0).alias("sources"), F.count(F.lit(1)).alias("total_sources"),
    ).withColumn("is_common", F.col("sources") == F.col("total_sources"))


def common_features(dfs: Sequence[DataFrame], exclude: Sequence[str] = ("ts", "label", "source")) -> list[str]:
    """Numeric columns that every table's schema has, in the order of the first table. Reads no data."""
    numeric = [{f.name for f in d.schema.fields if isinstance(f.dataType, T.NumericType)} for d in dfs]
    shared = reduce(lambda a, b: a & b, numeric)
    return [c for c in dfs[0].columns if c in shared and c not in exclude]


def feature_catalog(df: DataFrame, exclude: Sequence[str] = ("ts", "label", "source")) -> DataFrame:
    """(ordinal, feature, type) of every column that is not time, label or source."""
    rows = [(i, f.name, f.dataType.simpleString())
            for i, f in enumerate(f for f in df.schema.fields if f.name not in exclude)]
    return df.sparkSession.createDataFrame(rows, "ordinal bigint, feature string, type string")


def match_features(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(feature, found) for each wanted name."""
    have = catalog.select("feature", F.lit(True).alias("_h")).distinct()
    return (wanted.join(have, "feature", "left")
            .withColumn("found", F.coalesce("_h", F.lit(False))).drop("_h"))


def match_summary(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count_if("found").alias("n_found"), F.count_if(~F.col("found")).alias("n_missing"),
        N.ratio(F.count_if("found"), F.count(F.lit(1))).alias("found_ratio"))


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` plus the listed features that exist, in list order."""
    found = [n for n in names if n in df.columns]
    if not found:
        raise ValueError("none of the listed features exists in the table")
    return df.select(*keep, *[F.col(f"`{c}`") for c in found])


def clean_profile(raw: DataFrame, clean: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Per stage and label: rows, rows with an unusable value, benign-or-not totals come from the labels."""
    def stage(df, name):
        unusable = reduce(lambda a, b: a | b, [N.finite(N.to_number(F.col(f"`{c}`"))).isNull() for c in features])
        return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.count_if(unusable).alias("invalid_rows")
                                     ).withColumn("stage", F.lit(name))
    return stage(raw, "raw").unionByName(stage(clean, "clean"))


def null_census(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, nulls, rows): one aggregate over the table, then turned tall."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols], F.count(F.lit(1)).alias("rows"))
    return one.unpivot(["rows"], list(cols), "feature", "nulls")
