"""Cleaning of raw flow tables: names, times, labels, numbers, missing values, duplicates, category codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.functions import numbers as N
from flowpane.functions import vocabulary as V
from flowpane.operators.ordered import forward_fill, join_by_value, number_values, with_position


def harmonise_columns(df: DataFrame, aliases: Mapping[str, str] = V.COLUMN_ALIASES) -> DataFrame:
    """Rename aliases to canonical names; where several spellings are present, take the first non-null."""
    spellings: dict[str, list[str]] = {}
    for c in df.columns:
        spellings.setdefault(aliases.get(c, c), []).append(c)
    ref = lambda c: F.col(f"`{c}`")
    return df.select(*[
        (F.coalesce(*[ref(c) for c in cs]) if len(cs) > 1 else ref(cs[0])).alias(target)
        for target, cs in spellings.items()])


def drop_columns(df: DataFrame, names: Sequence[str] = tuple(V.UNUSED_COLUMNS)) -> DataFrame:
    return df.drop(*names)


def fix_half_day(df: DataFrame, ts: str = "ts", cutoff: int = 8) -> DataFrame:
    return df.withColumn(ts, N.half_day_fixed(F.col(ts), cutoff))


def ensure_ts(df: DataFrame, start: str, order: Sequence[str], ts: str = "ts") -> DataFrame:
    """A timestamp column one second apart from ``start``, in ``order``, when the table has none."""
    if ts in df.columns:
        return df
    numbered = with_position(df, [], order, pos="_i", count=None)
    return (numbered.withColumn(ts, F.timestamp_add("SECOND", F.col("_i"), F.lit(start).cast("timestamp")))
            .drop("_i"))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: N.to_number(F.col(f"`{c}`")) for c in cols})


def null_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: N.finite(F.col(f"`{c}`")) for c in cols})


def apply_na_policy(df: DataFrame, policy: str, cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """``drop``: rows with any null go. ``zero``: rows without a time go, other nulls become 0."""
    if policy == "drop":
        return df.dropna("any")
    if policy == "zero":
        return df.dropna(subset=[ts]).fillna(0.0, list(cols))
    raise ValueError(f"unknown policy {policy!r}")


def ffill_zero(df: DataFrame, cols: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return forward_fill(df, list(by), order, cols, 0.0)


def dedup_flows(df: DataFrame, order: Sequence[str], ignore: Sequence[str] = ("label", "ts")) -> DataFrame:
    """One row, the earliest in ``order``, for each distinct value of the columns not in ``ignore``.

    An aggregate rather than a ranking window: copies collapse before the shuffle, so a group of copies of any
    size reaches a reducer as one row per map task.
    """
    keys = [c for c in df.columns if c not in ignore and c not in order]
    carried = [c for c in df.columns if c not in keys]
    rest = [c for c in carried if c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_k")
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best).select(
        *[F.col(f"`{c}`") if c in keys else F.col(f"_k.`{c}`").alias(c) for c in df.columns])


def dedup_report(df: DataFrame, order: Sequence[str], label: str = "label",
                 ignore: Sequence[str] = ("label", "ts")) -> DataFrame:
    """Per label: rows, rows kept and rows removed by :func:`dedup_flows`."""
    before = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("kept"))
    after = dedup_flows(df, order, ignore).groupBy(label).agg(
        F.lit(0).cast("bigint").alias("rows"), F.count(F.lit(1)).alias("kept"))
    return (before.unionByName(after).groupBy(label)
            .agg(F.sum("rows").alias("rows"), F.sum("kept").alias("kept"))
            .withColumn("removed", F.col("rows") - F.col("kept")))


def category_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, code, n): distinct trimmed values numbered from 0 in sorted order, with their row counts."""
    seen = (df.groupBy(F.coalesce(F.trim(F.col(col)), F.lit("nan")).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))
    return number_values(seen, ["value"], "code")


def encode_categories(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace each column by its dictionary code; returns the table and the dictionaries."""
    out, dictionaries = df, {}
    for c in cols:
        d = category_dictionary(df, c)
        dictionaries[c] = d
        keyed = out.withColumn("value", F.coalesce(F.trim(F.col(c)), F.lit("nan"))).drop(c)
        out = join_by_value(keyed, d, ["value"], written=True).withColumnRenamed("code", c).drop("value", "n")
    return out.select(*df.columns), dictionaries


def label_dictionary(df: DataFrame, label: str = "label", benign: str = V.BENIGN) -> DataFrame:
    """(label, code, n) over all sources: benign is 0, the others follow alphabetically from 1."""
    seen = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("_attack", (F.col(label) != benign).cast("int")))
    placed = number_values(seen, ["_attack", label], "_p")
    first = 0 if placed.where(F.col(label) == benign).limit(1).count() else 1
    return placed.select(label, (F.col("_p") + first).cast("bigint").alias("code"), "n")


def encode_labels(df: DataFrame, dictionary: DataFrame, label: str = "label", out: str = "label_code") -> DataFrame:
    return join_by_value(df, dictionary, [label]).withColumnRenamed("code", out).drop("n")


def align_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add every agreed feature the table lacks, as 0."""
    return df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})


def canonical_labels(df: DataFrame, label: str = "label") -> DataFrame:
    out = df.withColumnRenamed("Label", label) if "Label" in df.columns and label != "Label" else df
    return out.withColumn(label, L.canonical_label(F.col(label)))
