"""Anomaly scores of windows and their fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpane.functions import signal as S
from flowpane.operators.ordered import average_ranks, join_by_value
from flowpane.session import materialise


def recon_score(series: DataFrame, recon: Column, key: Sequence[str]) -> DataFrame:
    """Mean over rows and channels of (x - recon)^2, per window. ``recon`` is an array as long as ``x``."""
    rows = series.select(*key, S.squared_error(F.col("x"), recon).alias("_e"), F.size("x").alias("_n"))
    return rows.groupBy(*key).agg((F.sum("_e") / F.sum("_n")).alias("recon_score"))


def residual_score(series: DataFrame, key: Sequence[str], residual: str = "residual") -> DataFrame:
    """:func:`recon_score` where the residual x - recon is at hand already."""
    rows = series.select(*key, F.explode(residual).alias("_r"))
    return rows.groupBy(*key).agg(F.avg(F.col("_r") * F.col("_r")).alias("recon_score"))


def spectral_baseline(spectra: DataFrame) -> DataFrame:
    """(channel, bin, mean, var): log-amplitude over the given (normal training) windows.

    One row per channel and bin; the shuffle carries one partial mean and variance of each per map task.
    """
    tall = spectra.select("channel", F.posexplode("amp").alias("bin", "a"))
    return tall.groupBy("channel", "bin").agg(F.avg("a").alias("mean"), F.var_pop("a").alias("var"))


def freq_score(spectra: DataFrame, baseline: DataFrame, key: Sequence[str], alpha: float = 2.0,
               weight=None) -> DataFrame:
    """Squared distance of log-amplitudes from the baseline, with the part above the normal variance counted
    ``alpha`` times more, averaged over channels and the masked bins (all but DC, each masked once).

    ``weight(bin)`` scales the squared distance of a bin instead of the boost. Bins meet the baseline, which is as
    small as a spectrum, in a broadcast, and are summed before any shuffle. A window with a bin that has no baseline keeps
    its row, with a null score.
    """
    bins = spectra.select(*key, "channel", F.posexplode("amp").alias("bin", "a")).where("bin > 0")
    e = (F.col("a") - F.col("mean")) * (F.col("a") - F.col("mean"))
    scored = e + alpha * F.greatest(e - F.col("var"), F.lit(0.0)) if weight is None else e * weight(F.col("bin"))
    joined = bins.join(materialise(baseline), ["channel", "bin"], "left")
    covered = F.count("mean") == F.count(F.lit(1))
    return joined.groupBy(*key).agg(F.when(covered, F.sum(scored) / (F.count(F.lit(1)) + 1e-8)).alias("freq_score"))


def rank_norm(df: DataFrame, col: str, by: Sequence[str] = ("split",), out: str | None = None) -> DataFrame:
    """(rank - 1) / (n - 1) with tied scores sharing their average rank; 0 where a group has one row."""
    ranks = average_ranks(df.select(*by, col), by, col).select(
        *by, col, "n", F.coalesce(F.try_divide(F.col("avg_rank") - 1, F.col("n_all") - 1), F.lit(0.0)).alias(
            out or f"{col}_rank"))
    return join_by_value(df, ranks, [*by, col]).drop("n")


def rank_fuse(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("split",), out: str = "fused_score") -> DataFrame:
    """Sum of the normalised ranks of the score branches, ranked within each group."""
    ranked = reduce(lambda d, c: rank_norm(d, c, by, f"_rank_{c}"), cols, df)
    return ranked.withColumn(out, reduce(lambda a, b: a + b, [F.col(f"_rank_{c}") for c in cols])).drop(
        *[f"_rank_{c}" for c in cols])


def zscore_fuse(df: DataFrame, cols: Sequence[str], baseline: DataFrame, out: str = "fused_score") -> DataFrame:
    """Sum of the branches standardised by mean and deviation of the baseline rows (normal validation windows)."""
    s = baseline.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    if any(s[f"m_{c}"] is None for c in cols):
        raise ValueError("no baseline rows to standardise by")
    parts = [(F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + 1e-8) for c in cols]
    return df.withColumn(out, reduce(lambda a, b: a + b, parts))


def score_table(df: DataFrame, branches: Sequence[str], keep: Sequence[str] = ("split",)) -> DataFrame:
    """Scores for export: split, group name, label and all branches."""
    group = F.when(F.col("label") == 1, "anomalous").otherwise("normal")
    return df.select(*keep, group.alias("group"), "label", *branches)


def score_by_class(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))
