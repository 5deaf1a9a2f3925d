"""Smoothing of series of any length: frames with borders, and first-order recursions as scans of affine maps.

A series is a ``by`` group in ``order``. Its rows are numbered (``with_position``) and cut into blocks of consecutive rows, so
that a series holding a third of all rows is spread like any other. What a block needs of its neighbours is either a bounded
number of rows, which are copied over the border, or one number, which a scan over the blocks provides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpane.operators.ordered import null_safe_join, with_position
from flowpane.session import materialise

BLOCK_ROWS = 8192


# ---- frames --------------------------------------------------------------------------------------------------------

def framed(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, Callable[[], Column]], before: int,
           after: int = 0) -> DataFrame:
    """``df`` with new columns: aggregates over the rows from ``before`` rows back to ``after`` rows ahead in the group.

    ``columns`` maps names to functions that make an aggregate, e.g. ``{"s": lambda: F.sum("value")}``. A block of rows
    receives the last ``before`` rows of the block in front of it and the first ``after`` rows of the one behind.
    ``order`` must be a total order up to identical rows.
    """
    size = max(BLOCK_ROWS, before, after)
    placed = with_position(df, by, order, pos="_pos", count=None)
    block, place = F.expr(f"_pos div {size}"), F.col("_pos") % size
    homes = F.array_compact(F.array(block, F.when(place >= size - before, block + 1),
                                    F.when((place < after) & (block > 0), block - 1)))
    frame = Window.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(-before, after)
    rows = placed.withColumn("_block", F.explode(homes)).withColumns({k: make().over(frame) for k, make in columns.items()})
    return rows.where(F.expr(f"_pos div {size}") == F.col("_block")).drop("_pos", "_block")


def moving_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int, out: str = "trend", centred: bool = False) -> DataFrame:
    """Mean of the last ``k`` rows of a long series, or of the ``k`` around (``k`` odd); fewer at its ends."""
    before, after = ((k - 1) // 2, (k - 1) // 2) if centred else (k - 1, 0)
    return framed(df, by, order, {out: lambda: F.avg(value)}, before, after)


# ---- scans ---------------------------------------------------------------------------------------------------------

def _composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps y -> a y + b composed from the first to each: log2(n) rounds over the whole block."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:], a[step:] = a[step:] * b[:-step] + b[step:], a[step:] * a[:-step]
        step *= 2
    return a, b


def _scan_block(table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table, [("_at", "ascending")]))
    a, b = _composed(table["_a"].to_numpy(), table["_b"].to_numpy())
    return table.set_column(table.schema.get_field_index("_a"), "_a", pa.array(a)).set_column(table.schema.get_field_index("_b"), "_b", pa.array(b))


def scan_affine(maps: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """``maps`` with ``out``: y after each row, where y -> _a y + _b is applied in the order of ``_at`` (0, 1, 2, ... in each group).

    Blocks compose their maps; what a whole block does is one map again, so the maps of blocks are scanned the same way, until
    every group is a single block. The value before a block then enters its rows by one multiplication each. The first
    map of a group must have ``_a`` = 0.
    """
    kinds = dict(maps.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in maps.columns)
    blocked = maps.withColumn("_block", F.expr(f"_at div {BLOCK_ROWS}L"))
    local = materialise(blocked.groupBy(*by, "_block").applyInArrow(_scan_block, f"{schema}, _block bigint"))
    ends = local.groupBy(*by, "_block").agg(F.max_by("_a", "_at").alias("_a"), F.max_by("_b", "_at").alias("_b"))
    if local.agg(F.max("_block").alias("m")).first()["m"] in (None, 0):
        return local.withColumn(out, F.col("_b")).drop("_a", "_b", "_block", "_at")
    joined = null_safe_join(local, _carried(ends, by), [*by, "_block"])
    return joined.withColumn(out, F.col("_b") + F.col("_a") * F.col("_y_in")).drop("_a", "_b", "_block", "_at", "_y_in")


def _carried(ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _block, _y_in): the value that enters each block."""
    after = scan_affine(ends.withColumn("_at", F.col("_block")).withColumnRenamed("_block", "_of"), by, "_y")
    after = after.select(*by, (F.col("_of") + 1).alias("_block"), F.col("_y").alias("_y_in"))
    first = ends.where("_block = 0").select(*by, "_block", F.lit(0.0).alias("_y_in"))
    return materialise(after.unionByName(first))


def _recursion(df: DataFrame, by: Sequence[str], value: str, alpha: float, out: str) -> DataFrame:
    """One exponential average over rows that are numbered by ``_pos``; rows stay numbered."""
    first = F.col("_pos") == 0
    maps = df.withColumns({"_at": F.col("_pos"), "_a": F.when(first, 0.0).otherwise(1.0 - alpha),
                           "_b": F.when(first, F.col(value)).otherwise(alpha * F.col(value))})
    return scan_affine(maps, by, out)


def exponential_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.3, double: bool = False,
                     out: str = "trend") -> DataFrame:
    """Exponential average of a long series: y0 = x0, y = alpha x + (1 - alpha) y; ``double``: 2 y - average of y.

    Rows whose value is null or not finite have a null average and are skipped by the others'. ``order`` must be a total
    order up to identical rows.
    """
    x = F.col(value).cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = with_position(df.where(usable).withColumn("_x", x), by, order, pos="_pos", count=None)
    smooth = _recursion(rows, by, "_x", alpha, out)
    if double:
        twice = _recursion(smooth, by, out, alpha, "_twice")
        smooth = twice.withColumn(out, 2 * F.col(out) - F.col("_twice")).drop("_twice")
    rest = df.where(~F.coalesce(usable, F.lit(False))).withColumn(out, F.lit(None).cast("double"))
    return smooth.drop("_pos", "_x").unionByName(rest)
