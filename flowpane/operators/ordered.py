"""Ordered scans that never put one key's rows into one task.

A running sum, a row position, a rank or an exact quantile is usually written as a window over
``partitionBy(key)``. That places a whole key in a single task. Here the rows are range-partitioned on
``(key, order)`` instead, so a hot key spreads over as many tasks as its size deserves, and the pieces are tied
together by a table with one row per (key, range): its size is the number of ranges plus the number of keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpane.session import materialise, shuffle_width

SEG = "_seg"
LOC = "_loc"
_LOC_MASK = (1 << 33) - 1
RANGE_BYTES = 256 << 20
RANGE_ROWS = 4_000_000  # of a written table, whose columns may be packed far below their size in memory
MOST_RANGES = 100_000
BROADCAST_ROWS = 100_000  # a table counted to be no larger is sent to all tasks


def _plan_bytes(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def planned_ranges(df: DataFrame, rows: int = 0) -> int | None:
    """Ranges of about ``RANGE_BYTES``, by the optimizer's estimate, and of at most ``RANGE_ROWS`` of a table known to have ``rows``;
    None where the shuffle's own width is enough, which adaptive execution merges down."""
    size = _plan_bytes(df._jdf.queryExecution().optimizedPlan())
    ranges = min(max(-(-size // RANGE_BYTES), -(-rows // RANGE_ROWS)), MOST_RANGES)
    return ranges if ranges > shuffle_width(df.sparkSession) else None


def sized(df: DataFrame) -> tuple[DataFrame, int | None]:
    """``df``, written if need be, and its number of ranges.

    The estimate of a join is the product of its sides, so after a few joins it is beyond all bounds and would cut a handful
    of rows into thousands of tasks. An estimate that exceeds the tables the plan reads is therefore not believed: the
    rows are written once, and the ranges follow from what was written.
    """
    ranges = planned_ranges(df)
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if ranges is None or _plan_bytes(plan) <= 2 * sum(_plan_bytes(leaves.apply(i)) for i in range(leaves.size())):
        return df, ranges
    written = materialise(df)
    return written, planned_ranges(written, written.count())


def range_segments(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in global (by, order) order with their range number ``_seg`` and place in it ``_loc``; written once.

    Range bounds are sampled, so they may differ between two evaluations of the same plan. The written table
    fixes them before anything is derived from the range numbers. The number of ranges follows the size of the table, and
    bounds are whole (by, order) keys: one that is held by a third of all rows in ``by`` alone is cut by its ``order``.
    """
    keys = [*by, *order]
    df, ranges = sized(df)
    placed = (df.repartitionByRange(*([ranges] if ranges else []), *keys)
              .sortWithinPartitions(*keys)
              .withColumn(SEG, F.spark_partition_id())
              .withColumn(LOC, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOC_MASK))))
    return materialise(placed)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; keeps one copy of the key columns."""
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"__r_{c}"), on, right)
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on])


def _before(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, by: Sequence[str], order: Sequence[str], pos: str = "pos",
                  count: str | None = "n_rows") -> DataFrame:
    """Number the rows of each ``by`` group 0..N-1 in ``order``; ``count`` carries N.

    ``order`` must be a total order up to identical rows.
    """
    seg = range_segments(df, by, order)
    parts = (seg.groupBy(*by, SEG).agg(F.count(F.lit(1)).alias("_n"), F.min(LOC).alias("_lo"))
             .withColumn("_start", F.coalesce(F.sum("_n").over(_before(by)), F.lit(0)) - F.col("_lo"))
             .withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
             .select(*by, SEG, "_start", "_all"))
    out = null_safe_join(seg, materialise(parts), [*by, SEG])
    out = out.withColumn(pos, (F.col("_start") + F.col(LOC)).cast("bigint"))
    if count:
        out = out.withColumn(count, F.col("_all").cast("bigint"))
    return out.drop("_start", "_all", LOC, SEG)


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str],
                   following: str | None = None) -> DataFrame:
    """Inclusive running sums ``<c>_cum`` and group totals ``<c>_all`` of each column in ``sums``; with
    ``following``, also that column's value in the next row of the group, ``<following>_next``.

    Meant for tables already aggregated to one row per (by, order): equal values must have been merged first, so
    that a value held by a third of all rows is one row here. Small tables end up in few ranges.
    """
    seg = range_segments(df, by, order)
    sorted_seg = Window.partitionBy(*by, SEG).orderBy(*order)
    local = sorted_seg.rowsBetween(Window.unboundedPreceding, 0)
    first = [F.min_by(following, LOC).alias("_first")] if following else []
    parts = seg.groupBy(*by, SEG).agg(*[F.sum(c).alias(c) for c in sums], *first)
    ahead = [F.lead("_first").over(Window.partitionBy(*by).orderBy(SEG)).alias("_ahead")] if following else []
    parts = parts.select(
        *by, SEG, *ahead,
        *[F.coalesce(F.sum(c).over(_before(by)), F.lit(0)).alias(f"_b_{c}") for c in sums],
        *[F.sum(c).over(Window.partitionBy(*by)).alias(f"{c}_all") for c in sums])
    out = null_safe_join(seg, parts, [*by, SEG])
    new = {f"{c}_cum": F.col(f"_b_{c}") + F.sum(c).over(local) for c in sums}
    if following:
        new[f"{following}_next"] = F.coalesce(F.lead(following).over(sorted_seg), F.col("_ahead"))
    return out.withColumns(new).drop(SEG, LOC, "_ahead", *[f"_b_{c}" for c in sums])


def value_counts(df: DataFrame, by: Sequence[str], col: str, **counts) -> DataFrame:
    """One row per distinct (by, value) with ``n`` and any extra conditional counts."""
    extra = [F.sum(e).alias(k) for k, e in counts.items()]
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"), *extra)


def _mark_span(probs: Sequence[float]):
    """(lo, hi, n) -> STRUCT<a, b>: which of the sorted ``probs`` have their rank, rounded down or up, in [lo, hi)."""
    p = np.asarray(probs, dtype=np.float64)

    def span(lo: pd.Series, hi: pd.Series, n: pd.Series) -> pd.DataFrame:
        first, last = np.zeros(len(lo), dtype=np.int32), np.zeros(len(lo), dtype=np.int32)
        sizes = n.to_numpy()
        for size in np.unique(sizes):
            at, h = sizes == size, p * (size - 1)
            first[at] = np.searchsorted(np.ceil(h), lo.to_numpy()[at], side="left")
            last[at] = np.searchsorted(np.floor(h), hi.to_numpy()[at], side="left")
        return pd.DataFrame({"a": first, "b": last})

    return F.pandas_udf(span, "a int, b int")


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per group: (by, prob, value). Exact at any size."""
    probs = sorted({float(p) for p in probs})
    runs = running_totals(value_counts(df, by, col), by, [col], ["n"])
    runs = runs.select(*by, F.col(col).alias("_v"), (F.col("n_cum") - F.col("n")).alias("_lo"), F.col("n_cum").alias("_hi"),
                       "n_all")
    # only the few values that hold a wanted rank go on
    runs = runs.withColumn("_s", _mark_span(probs)("_lo", "_hi", "n_all")).where("_s.a < _s.b")
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
    picked = runs.withColumn("_i", F.explode(F.sequence(F.col("_s.a"), F.col("_s.b") - 1))).withColumn("prob", prob)
    picked = picked.withColumn("_h", F.col("prob") * (F.col("n_all") - 1))
    inside = lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))
    h = F.col("_h")
    g = (picked.groupBy(*by, "prob")
         .agg(F.max(F.when(inside(F.floor(h)), F.col("_v"))).alias("_a"),
              F.max(F.when(inside(F.ceil(h)), F.col("_v"))).alias("_b"),
              F.first(h - F.floor(h)).alias("_t")))
    return g.select(*by, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("value"))


def average_ranks(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """One row per distinct (by, value): ``n``, ``n_all`` and the tie-averaged 1-based ``avg_rank``."""
    runs = running_totals(value_counts(df, by, col), by, [col], ["n"])
    return runs.withColumn("avg_rank", F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0)


def join_by_value(rows: DataFrame, values: DataFrame, on: Sequence[str], n: str = "n", how: str = "left",
                  written: bool = False) -> DataFrame:
    """Attach a per-value table (key columns and a few numbers) to the rows it was counted from.

    A table of at most ``BROADCAST_ROWS`` values is broadcast: its size has just been counted. Beyond that only
    the hot values are: a value is hot when it holds more than one shuffle partition's share of the rows, so there
    are fewer hot values than shuffle partitions. All other values go through an ordinary join.
    """
    values = values if written else materialise(values)
    facts = values.agg(F.count(F.lit(1)).alias("c"), F.sum(n).alias("t"), F.max(n).alias("m")).first()
    if facts["c"] <= BROADCAST_ROWS:
        return null_safe_join(rows, F.broadcast(values), on, how)
    cut = facts["t"] / shuffle_width(rows.sparkSession)
    if facts["m"] <= cut:
        return null_safe_join(rows, values, on, how)
    hot = values.where(F.col(n) > cut)
    tagged = null_safe_join(rows, F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    fast = null_safe_join(tagged.where("_hot").drop("_hot"), F.broadcast(hot), on, "inner")
    slow = null_safe_join(tagged.where("_hot is null").drop("_hot"), values.where(F.col(n) <= cut), on, how)
    return fast.unionByName(slow)


def number_values(values: DataFrame, order: Sequence[str], pos: str) -> DataFrame:
    """Number a table of distinct values from 0; written."""
    return materialise(with_position(values, [], order, pos=pos, count=None))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 default: float | None = 0.0) -> DataFrame:
    """Carry the last non-null value forward inside each group; what precedes the first value gets ``default``."""
    seg = range_segments(df, by, order)
    local = Window.partitionBy(*by, SEG).orderBy(LOC).rowsBetween(Window.unboundedPreceding, 0)
    parts = seg.groupBy(*by, SEG).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(LOC))).alias(c) for c in cols])
    parts = parts.select(*by, SEG, *[F.last(c, ignorenulls=True).over(_before(by)).alias(f"_b_{c}") for c in cols])
    out = null_safe_join(seg, materialise(parts), [*by, SEG])

    def filled(c):
        options = [F.last(c, ignorenulls=True).over(local), F.col(f"_b_{c}")]
        return F.coalesce(*options, *([F.lit(default)] if default is not None else []))

    return out.withColumns({c: filled(c) for c in cols}).drop(SEG, LOC, *[f"_b_{c}" for c in cols])
