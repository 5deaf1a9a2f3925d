"""Overlapping row-count windows over positioned flows.

The input of everything here is a table from ``with_position``: each row knows its place ``pos`` in its source and
the source's row count ``n_rows``. Window ``i`` covers rows ``[i*step, i*step + size)``.

Each row belongs to up to ``ceil(size/step)`` windows. Copying rows that often through a shuffle is avoided by
working on *panes*: runs of ``gcd(size, step)`` rows, of which every window is a whole number. Rows are reduced to
panes once, and a window is a frame over neighbouring panes. Panes are grouped in blocks of consecutive panes, each
with the few panes that follow it, so that a single very long source still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.functions import vocabulary as V
from flowpane.operators.ordered import null_safe_join, running_totals, with_position


@dataclass(frozen=True)
class WindowSpec:
    size: int = 100
    step: int = 20
    source: str = "source"
    ts: str = "ts"
    label: str = "label"
    benign: str = V.BENIGN

    @property
    def pane(self) -> int:
        return gcd(self.size, self.step)

    @property
    def panes_per_window(self) -> int:
        return self.size // self.pane

    @property
    def panes_per_step(self) -> int:
        return self.step // self.pane


def position_flows(df: DataFrame, spec: WindowSpec, order: Sequence[str]) -> DataFrame:
    """Rows numbered in time order within each source."""
    return with_position(df, [spec.source], order)


def window_count(n_rows: Column, spec: WindowSpec) -> Column:
    full = F.floor((n_rows - spec.size) / spec.step) + 1  # one value per source
    return F.when(n_rows >= spec.size, full).otherwise(F.lit(0)).cast("bigint")


def sliding_windows(df: DataFrame, spec: WindowSpec) -> DataFrame:
    """Long form: one row per (window, row), with the row's ``offset`` in the window. Needs no shuffle."""
    last = F.expr(f"least((n_rows - {spec.size}) div {spec.step}, pos div {spec.step})")
    first = F.expr(f"greatest(0L, (pos - {spec.size} + {spec.step}) div {spec.step})")
    return (df.where(F.col("n_rows") >= spec.size).withColumn("_f", first).withColumn("_t", last).where("_f <= _t")
            .withColumn("window_id", F.explode(F.sequence("_f", "_t")))
            .withColumn("offset", F.col("pos") - F.col("window_id") * spec.step).drop("_f", "_t"))


def _blocks(df: DataFrame, spec: WindowSpec, panes_per_block: int) -> DataFrame:
    pane = F.expr(f"pos div {spec.pane}")
    block = F.expr(f"_pane div {panes_per_block}")
    in_halo = (F.col("_pane") % panes_per_block < spec.panes_per_window - 1) & (block > 0)
    homes = F.when(in_halo, F.array(block, block - 1)).otherwise(F.array(block))
    return df.withColumn("_pane", pane).withColumn("_block", F.explode(homes))


ROWS_PER_TASK = 50_000


def _tasks_for(df: DataFrame) -> int:
    """Width of a shuffle before work that is heavy on computing and light on bytes: tasks must not be merged by
    their size in bytes there, so the width comes from the number of rows (a count over the written table)."""
    spark = df.sparkSession
    return max(1, spark.sparkContext.defaultParallelism, df.count() // ROWS_PER_TASK)


def pane_windows(df: DataFrame, spec: WindowSpec, pane_aggs: dict[str, Column], window_aggs: dict[str, Column],
                 whole_rows: bool = False, post: dict[str, Column] | None = None) -> DataFrame:
    """One row per window, from pane aggregates combined over a frame of panes.

    ``window_aggs`` refer to the names in ``pane_aggs`` and are evaluated over the frame. ``whole_rows`` says that
    the pane aggregates keep the rows themselves: partial aggregation would save nothing, so rows are shuffled once
    by block and both steps run on that partitioning.
    """
    per_block = max(256, 8 * spec.panes_per_window)
    rows = _blocks(df, spec, per_block)
    if whole_rows:
        rows = rows.repartition(_tasks_for(df), spec.source, "_block")
    panes = rows.groupBy(spec.source, "_block", "_pane").agg(
        F.max("n_rows").alias("_n"), *[e.alias(k) for k, e in pane_aggs.items()])
    frame = (Window.partitionBy(spec.source, "_block").orderBy("_pane")
             .rowsBetween(0, spec.panes_per_window - 1))
    starts = (F.col("_pane") % spec.panes_per_step == 0) & (F.col("_pane") * spec.pane + spec.size <= F.col("_n")) & (
        F.expr(f"_pane div {per_block}") == F.col("_block"))
    out = panes.withColumns({k: e.over(frame) for k, e in _distinct(window_aggs).items()}).where(starts)
    start = (F.col("_pane") * spec.pane).cast("bigint")
    names = [f"_w_{k}" for k in window_aggs]
    out = out.select(spec.source, F.expr(f"_pane div {spec.panes_per_step}").alias("window_id"),
                     start.alias("start_idx"), (start + spec.size).alias("end_idx"),
                     *[F.col(n).alias(k) for n, k in zip(names, window_aggs)])
    return out.withColumns(post) if post else out


def _distinct(aggs: dict[str, Column]) -> dict[str, Column]:
    return {f"_w_{k}": e for k, e in aggs.items()}


def window_rows(df: DataFrame, spec: WindowSpec, cols: Sequence[str]) -> DataFrame:
    """One row per window holding its rows in order: ``rows ARRAY<STRUCT<pos, cols...>>``."""
    piece = F.sort_array(F.collect_list(F.struct("pos", *cols)))
    return pane_windows(df, spec, {"piece": piece}, {"rows": F.collect_list("piece")}, whole_rows=True,
                        post={"rows": F.flatten("rows")})


def window_series(df: DataFrame, spec: WindowSpec, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per (window, channel): ``x ARRAY<DOUBLE>`` in row order, and ``is_malicious`` when labels exist."""
    wide, keep = _labelled_rows(df, spec, features)
    channels = F.explode(F.array(*[
        F.struct(F.lit(f).alias("channel"), F.col("rows").getField(f).alias("x")) for f in features]))
    out = wide.select(*keep, channels.alias("c"))
    return out.select(*[c for c in out.columns if c != "c"], "c.channel", "c.x")


def _labelled_rows(df: DataFrame, spec: WindowSpec, features: Sequence[str]) -> tuple[DataFrame, list]:
    """Windows with their rows, and the columns that tell them apart, ``is_malicious`` among them when labels exist."""
    has_label = spec.label in df.columns
    base = df.withColumn("_mal", L.is_malicious(F.col(spec.label), spec.benign)) if has_label else df
    wide = window_rows(base, spec, [*features, *(["_mal"] if has_label else [])])
    return wide, [spec.source, "window_id", "start_idx",
                  *([F.array_max(F.col("rows").getField("_mal")).alias("is_malicious")] if has_label else [])]


def window_vectors(df: DataFrame, spec: WindowSpec, features: Sequence[str]) -> DataFrame:
    """One row per window: ``vectors``, its rows as arrays of the features, and ``is_malicious`` when labels exist."""
    wide, keep = _labelled_rows(df, spec, features)
    return wide.select(*keep, F.transform("rows", lambda r: F.array(*[r.getField(f).cast("double") for f in features])).alias("vectors"))


def window_labels(df: DataFrame, spec: WindowSpec, min_ratio: float = 0.0) -> DataFrame:
    """Per window: malicious rows, their share, and the label ``share > min_ratio``. Only counts are shuffled."""
    mal = F.sum(L.is_malicious(F.col(spec.label), spec.benign))
    return pane_windows(df, spec, {"m": mal}, {"n_malicious": F.sum("m")}, post={
        "malicious_ratio": F.col("n_malicious") / spec.size,
        "is_malicious": (F.col("n_malicious") / spec.size > min_ratio).cast("int")})


def attack_counts(df: DataFrame, spec: WindowSpec) -> DataFrame:
    """(source, window_id, attack, n): the malicious rows of each window by label, windows without one left out.

    Rows of one attack that enter and leave at the same windows are one count. A count is added where it enters and taken off
    where it leaves; the running sum of these differences along a source's windows is what a window holds, constant between two
    borders. Only attacks are touched, and no labels are gathered. A missing label is an attack of unknown kind.
    """
    first = F.expr(f"greatest(0L, (pos - {spec.size} + {spec.step}) div {spec.step})")
    after = F.expr(f"least((n_rows - {spec.size}) div {spec.step}, pos div {spec.step}) + 1")
    bad = df.where((F.col("n_rows") >= spec.size) & (L.is_malicious(F.col(spec.label), spec.benign) == 1))
    spans = (bad.select(spec.source, F.coalesce(F.col(spec.label), F.lit(V.UNKNOWN)).alias("attack"), first.alias("_f"), after.alias("_t"))
             .where("_f < _t").groupBy(spec.source, "attack", "_f", "_t").agg(F.count(F.lit(1)).alias("_n")))
    border = F.explode(F.array(F.struct(F.col("_f").alias("w"), F.col("_n").alias("d")), F.struct(F.col("_t").alias("w"), (-F.col("_n")).alias("d"))))
    borders = (spans.select(spec.source, "attack", border.alias("b")).groupBy(spec.source, "attack", F.col("b.w").alias("w"))
               .agg(F.sum("b.d").alias("d")).where("d <> 0"))
    runs = running_totals(borders, [spec.source, "attack"], ["w"], ["d"], following="w").where("d_cum > 0")
    return runs.select(spec.source, F.explode(F.sequence(F.col("w"), F.col("w_next") - 1)).alias("window_id"), "attack", F.col("d_cum").alias("n"))


def window_meta(df: DataFrame, spec: WindowSpec, min_ratio: float = 0.0, original_labels: bool = False) -> DataFrame:
    """Per window: bounds, times, label, attack counts, primary attack and, if asked for, the row labels in order.

    ``primary_attack`` is the most frequent attack, the alphabetically first among equals. The counts of ``attack_types`` add up to
    ``n_malicious``: a missing label is malicious and counts as unknown.
    """
    pane = {"t0": F.min_by(spec.ts, "pos"), "t1": F.max_by(spec.ts, "pos"), "m": F.sum(L.is_malicious(F.col(spec.label), spec.benign))}
    over = {"start_time": F.first("t0"), "end_time": F.last("t1"), "n_malicious": F.sum("m")}
    if original_labels:
        pane["piece"] = F.sort_array(F.collect_list(F.struct("pos", F.col(spec.label).alias("label"))))
        over["pieces"] = F.collect_list("piece")
    wins = pane_windows(df, spec, pane, over, whole_rows=original_labels)
    if original_labels:
        wins = wins.withColumn("original_labels", F.flatten("pieces").getField("label")).drop("pieces")
    counts = attack_counts(df, spec).groupBy(spec.source, "window_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("attack").alias("label"), "n"))).alias("_c"),
        F.min(F.struct((-F.col("n")).alias("o"), F.col("attack").alias("label"))).getField("label").alias("primary_attack"))
    out = null_safe_join(wins, counts, [spec.source, "window_id"], "left")
    none = F.array().cast("array<struct<label:string,n:bigint>>")
    return (out.withColumn("is_malicious", (F.col("n_malicious") / spec.size > min_ratio).cast("int"))
            .withColumn("attack_types", F.map_from_entries(F.coalesce("_c", none))).drop("_c"))


def source_sizes(df: DataFrame, spec: WindowSpec, source_order: Sequence[str] | None = None) -> DataFrame:
    """(source, n_rows, n_windows, first_global_id) in the declared order, or by name. One row per source.

    Sources that were not declared, the null one among them, follow the declared ones by name.
    """
    sizes = (df.groupBy(spec.source).agg(F.max("n_rows").alias("n_rows"))
             .withColumn("n_windows", window_count(F.col("n_rows"), spec)))
    if source_order is None:
        place = F.lit(0)
    else:
        declared = F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col(spec.source))
        place = F.coalesce(F.nullif(declared, F.lit(0)), F.lit(len(source_order) + 1))
    w = Window.orderBy(place, spec.source).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first_global_id", F.coalesce(F.sum("n_windows").over(w), F.lit(0)).cast("bigint"))


def integrate(meta: DataFrame, sizes: DataFrame, spec: WindowSpec) -> DataFrame:
    """Windows of all sources in one sequence: ``global_window_id`` is the source's offset plus the window's id."""
    offsets = sizes.select(spec.source, "first_global_id")
    return (null_safe_join(meta, offsets, [spec.source])
            .withColumn("global_window_id", F.col("first_global_id") + F.col("window_id")).drop("first_global_id"))


def source_index(meta: DataFrame, source: str = "source") -> DataFrame:
    """[start, end) of each source in the global window sequence."""
    return meta.groupBy(source).agg(F.min("global_window_id").alias("start"),
                                    (F.max("global_window_id") + 1).alias("end"))


def flatten_windows(windows: DataFrame, features: Sequence[str], keep: Sequence[str] = ("label",)) -> DataFrame:
    """Flow rows with the multiplicity they have in the windows: the long form without window columns."""
    return windows.select(*keep, *features)


def verify_windows(windows: DataFrame, meta: DataFrame, spec: WindowSpec, features: Sequence[str]) -> DataFrame:
    """One row: window and row counts, windows of the wrong length, windows on one side only, feature count."""
    keys = [spec.source, "window_id"]
    per = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = per.join(meta.select(*keys, F.lit(1).alias("_m")), keys, "full")
    return both.agg(
        F.count("n").alias("windows"), F.count("_m").alias("meta_windows"), F.sum("n").alias("rows"),
        F.count_if(F.col("n") != spec.size).alias("wrong_length"),
        F.count_if(F.col("n").isNull() | F.col("_m").isNull()).alias("unmatched"),
        F.lit(len([f for f in features if f in windows.columns])).cast("bigint").alias("features"))
