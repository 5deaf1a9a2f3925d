"""Splits of the window sequence into train, val and test, and what they contain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpane.functions import numbers as N

GID = "global_window_id"


def split_points(total: int, train: float = 0.6, val: float = 0.2) -> tuple[int, int]:
    return int(total * train), int(total * (train + val))


def _named(gid: Column, cuts: tuple[int, int]) -> Column:
    return F.when(gid < cuts[0], "train").when(gid < cuts[1], "val").otherwise("test")


def total_windows(sizes: DataFrame) -> int:
    """Number of windows, from the per-source sizes."""
    return sizes.agg(F.sum("n_windows").alias("n")).first()["n"] or 0


def split_chrono(meta: DataFrame, total: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Chronological split of the global window sequence."""
    return meta.withColumn("split", _named(F.col(GID), split_points(total, train, val)))


def split_unsupervised(meta: DataFrame, total: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Chronological split whose train part keeps normal windows only."""
    return split_chrono(meta, total, train, val).where("split <> 'train' or is_malicious = 0")


def split_info(chrono: DataFrame) -> DataFrame:
    """One row of counts about an unfiltered chronological split."""
    def n(split, mal=None):
        hit = F.col("split") == split
        return F.count_if(hit if mal is None else hit & (F.col("is_malicious") == mal))
    return chrono.agg(
        n("train").alias("train_before_filter"), n("train", 1).alias("train_removed"), n("train", 0).alias("train_normal"),
        n("val").alias("val_total"), n("val", 0).alias("val_normal"), n("val", 1).alias("val_anomalous"),
        n("test").alias("test_total"), n("test", 0).alias("test_normal"), n("test", 1).alias("test_anomalous"))


def split_assess(info: DataFrame) -> DataFrame:
    """Is the number of normal training windows enough?"""
    n = F.col("train_normal")
    return info.select("train_normal", F.when(n > 10000, "sufficient").when(n > 3000, "adequate")
                       .otherwise("insufficient").alias("verdict"))


def split_by_source(meta: DataFrame, train: Sequence[str], val: Sequence[str], test: Sequence[str],
                    source: str = "source", keep_rest: bool = False) -> DataFrame:
    """Split by source: train and val take normal windows; malicious windows of a val source that is also a test
    source go to test. Windows that no rule takes belong to no part: they are left out, or kept with a null split."""
    s, normal = F.col(source), F.col("is_malicious") == 0
    rule = (F.when(s.isin(*train) & normal, "train").when(s.isin(*val) & normal, "val")
            .when(s.isin(*test) & (~s.isin(*val) | ~normal), "test"))
    out = meta.withColumn("split", rule)
    return out if keep_rest else out.where("split is not null")


def split_purity(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("windows"),
                                      (F.avg("is_malicious") * 100).alias("anomaly_rate"))


def balanced_points(meta: DataFrame, target: float = 0.25, tol: float = 0.03, source: str = "source") -> DataFrame:
    """One row: the pair of source boundaries that brings the malicious share of the three parts closest to
    ``target`` (val counts double), whether val is within ``tol``, and whether the fallback was used.

    Works on one row per source; pairs are made by an equi-join on the boundary's number.
    """
    per = meta.groupBy(source).agg(F.max(GID).alias("last"), F.count(F.lit(1)).alias("n"),
                                   F.sum("is_malicious").alias("m"))
    w = Window.orderBy("last")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    bounds = per.select((F.row_number().over(w) - 1).alias("i"), F.sum("n").over(run).alias("b"),
                        F.sum("m").over(run).alias("c"))
    bounds = bounds.withColumns({"sources": F.count(F.lit(1)).over(Window.partitionBy()),
                                 "total": F.max("b").over(Window.partitionBy()),
                                 "bad": F.max("c").over(Window.partitionBy())})
    share = lambda bad, n: F.coalesce(F.try_divide(bad.cast("double"), n.cast("double")), F.lit(0.0))
    first = bounds.where("i between 1 and sources - 2").withColumn("j", F.explode(F.expr("sequence(i + 1, sources - 1)")))
    second = bounds.select(F.col("i").alias("j"), F.col("b").alias("b2"), F.col("c").alias("c2"))
    pairs = first.join(second, "j").where(F.col("b2") < F.col("total") * 0.9)
    tr, va, te = (share(F.col("c"), F.col("b")), share(F.col("c2") - F.col("c"), F.col("b2") - F.col("b")),
                  share(F.col("bad") - F.col("c2"), F.col("total") - F.col("b2")))
    score = F.abs(tr - target) + 2 * F.abs(va - target) + F.abs(te - target)
    best = pairs.withColumns({"score": score, "va": va}).agg(
        F.min(F.struct("score", "i", "j", "b", "b2", "va")).alias("s"))
    row = best.select("s.score", F.col("s.b").alias("train_end"), F.col("s.b2").alias("val_end"), "s.va").first()
    if row["train_end"] is not None:
        return best.select(F.col("s.b").alias("train_end"), F.col("s.b2").alias("val_end"),
                           F.col("s.va").alias("val_ratio"), (F.abs(F.col("s.va") - target) <= tol).alias("in_tolerance"),
                           F.lit(False).alias("fallback"))
    total = meta.count()
    a, b = int(total * 0.65), int(total * 0.80)
    in_val = (F.col(GID) >= a) & (F.col(GID) < b)
    ratio = F.coalesce(F.avg(F.when(in_val, F.col("is_malicious"))), F.lit(0.0))
    return meta.agg(ratio.alias("val_ratio")).select(
        F.lit(a).cast("bigint").alias("train_end"), F.lit(b).cast("bigint").alias("val_end"), "val_ratio",
        (F.abs(F.col("val_ratio") - target) <= tol).alias("in_tolerance"), F.lit(True).alias("fallback"))


def split_balanced(meta: DataFrame, points: DataFrame) -> DataFrame:
    p = points.first()
    return meta.withColumn("split", _named(F.col(GID), (p["train_end"], p["val_end"])))


def attack_by_split(split: DataFrame) -> DataFrame:
    """Windows per primary attack and split, with the share of each attack in train and in test."""
    t = (split.withColumn("attack", F.when(F.col("is_malicious") == 1, F.coalesce("primary_attack", F.lit("Unknown")))
                          .otherwise("Benign"))
         .groupBy("attack").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).fillna(0))
    total = F.col("train") + F.col("val") + F.col("test")
    return t.withColumns({"total": total, "train_pct": N.ratio(F.col("train") * 100, total),
                          "test_pct": N.ratio(F.col("test") * 100, total)})
