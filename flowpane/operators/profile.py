"""Counts, shares, histograms and episodes: what a window set contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpane.functions import numbers as N
from flowpane.functions import vocabulary as V
from flowpane.operators.ordered import exact_quantiles, running_totals


def _n():
    return F.count(F.lit(1))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share), from one count per label."""
    g = df.groupBy(label).agg(_n().alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), label)


def flow_distribution(split_meta: DataFrame, size: int, benign: str = V.BENIGN) -> DataFrame:
    """(split, label, n, pct) of flow rows, counted once per window they are in.

    The label counts of a window are already in its metadata, so no row is copied.
    """
    benign_part = F.struct(F.lit(benign).alias("label"), (size - F.col("n_malicious")).alias("n"))
    attack_part = F.transform(F.map_entries("attack_types"), lambda e: F.struct(
        e["key"].alias("label"), e["value"].alias("n")))
    rows = split_meta.select("split", F.explode(F.concat(F.array(benign_part), attack_part)).alias("e"))
    g = rows.groupBy("split", F.col("e.label").alias("label")).agg(F.sum("e.n").alias("n")).where("n > 0")
    return g.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy("split")))


def window_distribution(split_meta: DataFrame) -> DataFrame:
    g = split_meta.groupBy("split").agg(
        _n().alias("windows"), F.count_if(F.col("is_malicious") == 0).alias("normal_windows"),
        F.count_if(F.col("is_malicious") == 1).alias("malicious_windows"))
    return g.withColumn("malicious_pct", F.col("malicious_windows") * 100 / F.col("windows"))


def malicious_ratio_stats(split_meta: DataFrame) -> DataFrame:
    r = F.col("malicious_ratio")
    return split_meta.groupBy("split").agg(
        F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"),
        F.count_if(r == 0).alias("none"), F.count_if(r == 1).alias("full"),
        F.count_if((r > 0) & (r < 1)).alias("mixed"))


def distribution_report(split_meta: DataFrame, size: int) -> DataFrame:
    """Flow counts and window counts per split in one tidy table: (split, level, label, n, pct)."""
    flow = flow_distribution(split_meta, size).select("split", F.lit("flow").alias("level"), "label", "n", "pct")
    w = window_distribution(split_meta)
    pick = lambda name, col: F.struct(F.lit(name).alias("label"), F.col(col).alias("n"))
    wins = w.select("split", "windows", F.explode(F.array(
        pick("normal", "normal_windows"), pick("malicious", "malicious_windows"))).alias("e"))
    wins = wins.select("split", F.lit("window").alias("level"), "e.label", "e.n",
                       (F.col("e.n") * 100 / F.col("windows")).alias("pct"))
    return flow.unionByName(wins)


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = (), lo: float | None = None,
              hi: float | None = None, density: bool = False) -> DataFrame:
    """(by, bin, left, right, n[, density]): equal-width bins, the last one closed, empty bins included.

    Without bounds the range is that of the whole column, 0 to 1 if it has no values. ``density`` divides by group size and bin width.
    """
    if lo is None or hi is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = r["lo"], r["hi"]
        if lo is None:
            lo, hi = 0.0, 1.0
        elif lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = N.equal_width_bin(F.col(col), F.lit(lo), F.lit(hi), bins)
    counted = df.groupBy(*by, slot.alias("bin")).agg(_n().alias("n")).where("bin is not null")
    # every group shows every bin: zero rows per group and bin are added before the sum
    groups = df.groupBy(*by).agg(F.lit(0).cast("bigint").alias("n")) if by else df.groupBy().agg(
        F.lit(0).cast("bigint").alias("n"))
    empty = groups.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    out = (counted.unionByName(empty).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
           .withColumn("left", F.lit(lo) + F.col("bin") * width).withColumn("right", F.lit(lo) + (F.col("bin") + 1) * width))
    if density:
        inside = F.sum("n").over(Window.partitionBy(*by))
        out = out.withColumn("density", N.ratio(F.col("n"), inside * width))
    return out


def daily_distribution(meta: DataFrame, source: str = "source") -> DataFrame:
    """Normal and abnormal windows per source and, in the row whose source is null, in total."""
    g = meta.rollup(source).agg(
        F.count_if(F.col("is_malicious") == 0).alias("normal"), F.count_if(F.col("is_malicious") == 1).alias("abnormal"),
        _n().alias("total"), F.grouping(source).cast("int").alias("is_total"))
    return g.withColumns({"abnormal_pct": N.ratio(F.col("abnormal") * 100, F.col("total")),
                          "normal_per_abnormal": F.try_divide(F.col("normal").cast("double"), F.col("abnormal"))})


def attack_breakdown(meta: DataFrame) -> DataFrame:
    """Windows containing each attack type and rows of it, over malicious windows."""
    e = meta.where("is_malicious = 1").select(F.explode("attack_types").alias("attack", "n"))
    return e.groupBy("attack").agg(_n().alias("windows"), F.sum("n").alias("flow_rows"))


def integration_summary(meta: DataFrame, size: int, source: str = "source", benign: str = V.BENIGN) -> DataFrame:
    """(section, key, n, share): windows by class, windows by source, flow rows by label."""
    cls = F.when(F.col("is_malicious") == 1, "malicious").otherwise("normal")
    one = meta.select(source, cls.alias("cls")).groupBy(source, "cls").agg(_n().alias("n"))
    wins = one.groupingSets([["cls"], [source]], "cls", source).agg(F.sum("n").alias("n"), F.grouping("cls").alias("g"))
    wins = wins.select(F.when(F.col("g") == 0, "windows_by_class").otherwise("windows_by_source").alias("section"),
                       F.when(F.col("g") == 0, F.col("cls")).otherwise(F.col(source)).alias("key"), "n")
    flow = flow_distribution(meta.withColumn("split", F.lit("all")), size, benign).select(
        F.lit("flows_by_label").alias("section"), F.col("label").alias("key"), "n")
    return wins.unionByName(flow).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("section")))


def attack_episodes(meta: DataFrame, size: int) -> DataFrame:
    """Maximal runs of consecutive malicious windows with the same primary attack; duration = windows * size.

    A run starts where the window before it (an equi-join on the id) is no such window; the running count of starts
    numbers the runs. No sequence of windows is gathered in one task.
    """
    bad = meta.where("is_malicious = 1").select(
        "global_window_id", F.coalesce("primary_attack", F.lit("Unknown")).alias("attack"))
    prev = bad.select((F.col("global_window_id") + 1).alias("global_window_id"), F.col("attack").alias("_before"))
    starts = bad.join(prev, "global_window_id", "left").withColumn(
        "_start", F.when(F.col("_before") == F.col("attack"), 0).otherwise(1)).drop("_before")
    runs = running_totals(starts, [], ["global_window_id"], ["_start"])
    return (runs.groupBy(F.col("_start_cum").alias("episode")).agg(
        F.first("attack").alias("attack"), F.min("global_window_id").alias("first_window"),
        F.max("global_window_id").alias("last_window"), _n().alias("windows"))
        .withColumn("duration", F.col("windows") * size))


def episode_stats(episodes: DataFrame) -> DataFrame:
    d = F.col("duration")
    g = episodes.groupBy("attack").agg(
        _n().alias("episodes"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"),
        F.stddev_pop(d).alias("std"))
    med = exact_quantiles(episodes, ["attack"], "duration", [0.5]).select("attack", F.col("value").alias("median"))
    return g.join(med, "attack")


def check_normalised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std): near 0 and 1 after scaling. One aggregate for all features."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in features])
    return one.unpivot([], list(features), "feature", "s").select("feature", "s.mean", "s.std")
