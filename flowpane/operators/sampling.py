"""Reproducible samples: rows are ordered by a hash of their key, the smallest hashes are taken."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpane.operators.ordered import with_position
from flowpane.session import materialise

HASH_RANGE = 1 << 32


def sample_hash(key: Column, seed: int) -> Column:
    """Uniform integer in [0, 2^32) from the text of the key: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")


def sample_exact(df: DataFrame, key: str, quotas: Mapping, seed: int, by: str | None = None) -> DataFrame:
    """Exactly ``quotas[class]`` rows (or all, if fewer) of each class, those with the smallest hashes.

    ``key`` must identify a row. Only rows with a hash below a bound can be among the smallest: the bound is set
    generously, the counts beneath it are checked, and if a class falls short the bound is not used. The rows below
    the bound are few more than the sample, and are written once.
    """
    rows = df.withColumn("_class", (F.col(by) if by else F.lit("all")).cast("string")).withColumn(
        "_h", sample_hash(F.col(key), seed))
    wanted = {str(k): int(v) for k, v in quotas.items()}
    sizes = {r["_class"]: r["count"] for r in
             rows.where(F.col("_class").isin(*wanted)).groupBy("_class").count().collect()}
    if not sizes:
        return df.limit(0)
    bound = {k: int(min(1.0, (1.2 * wanted[k] + 50) / n) * HASH_RANGE) for k, n in sizes.items()}
    per_class = F.create_map(*[F.lit(v) for kv in bound.items() for v in kv])
    near = materialise(rows.where(F.col("_h") < F.try_element_at(per_class, F.col("_class"))))
    got = {r["_class"]: r["count"] for r in near.groupBy("_class").count().collect()}
    if any(got.get(k, 0) < min(wanted[k], n) for k, n in sizes.items()):
        near, got = rows.where(F.col("_class").isin(*wanted)), sizes
    placed = with_position(near, ["_class"], ["_h", key], pos="_rank", count=None)
    quota = F.create_map(*[F.lit(v) for k in sizes for v in (k, wanted[k])])
    return placed.where(F.col("_rank") < F.try_element_at(quota, F.col("_class"))).select(*df.columns)


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """A sample of ``n`` rows that keeps the share of the 0/1 ``label``; the whole table if it is not larger."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    if total <= n:
        return df
    attacks = int(n * (counts.get(1, 0) / total))
    return sample_exact(df, key, {1: attacks, 0: n - attacks}, seed, label)


def sample_windows(windows: DataFrame, total: int, ratio: float, seed: int,
                   key: str = "global_window_id") -> DataFrame:
    """Whole windows: ``int(total * ratio)`` of them."""
    return sample_exact(windows, key, {"all": int(total * ratio)}, seed)
