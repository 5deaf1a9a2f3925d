"""Decomposition of window series: moving averages, exponential averages, spectral filters.

All take a table with ``x ARRAY<DOUBLE>`` (from ``window_series``) and add columns; no shuffle is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpane.functions import signal as S
from flowpane.operators.window_features import instance_norm

X = "x"


def _parts(df: DataFrame, split: Column) -> DataFrame:
    """The fields of a split as columns."""
    return df.withColumn("_s", split).select(*df.columns, "_s.*")


def sma(df: DataFrame, k: int = 25) -> DataFrame:
    return df.withColumn("trend", S.centred_mean(F.col(X), k))


def causal_sma(df: DataFrame, k: int = 25) -> DataFrame:
    return df.withColumn("trend", S.causal_mean(F.col(X), k))


def ema(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    return df.withColumn("trend", S.ema(F.col(X), alpha))


def dema(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    return df.withColumn("trend", S.dema(F.col(X), alpha))


def decompose_ma(df: DataFrame, k: int = 25) -> DataFrame:
    return _parts(df, S.mean_split(F.col(X), [k]))


def decompose_ma_multi(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Trend: the average of the moving averages of several widths."""
    return _parts(df, S.mean_split(F.col(X), ks))


def dft_energy_filter(df: DataFrame, top_k: int = 5, low: float = 0.4, tau: float = 0.95) -> DataFrame:
    return df.withColumn("seasonal", S.energy_filtered(F.col(X), top_k, low, tau))


def dft_topk(df: DataFrame, top_k: int = 5, low: float = 0.4) -> DataFrame:
    return _parts(df, S.strongest_bins(F.col(X), top_k, low))


def decompose(df: DataFrame, trend: str = "ema", alpha: float = 0.3, k: int = 25, top_k: int = 5, low: float = 0.5,
              tau: float = 0.97) -> DataFrame:
    """x = trend + seasonal + residual; seasonal is the energy-filtered part of what the trend leaves."""
    return _parts(df, S.three_way_split(F.col(X), trend, alpha, k, top_k, low, tau))


def hp_filter(df: DataFrame, lamb: float = 6400.0) -> DataFrame:
    return _parts(df, S.hodrick_prescott(F.col(X), lamb))


def lowpass(df: DataFrame, cut: int, eps: float = 1e-5) -> DataFrame:
    """Instance-normalise (sample variance), keep the first ``cut`` bins, undo the normalisation."""
    n = instance_norm(df, "mean", eps, unbiased=True)
    n = n.withColumn(X, S.low_passed(F.col(X), cut))
    return n.withColumn("smooth", S.restored(F.col(X), F.col("centre"), F.col("scale"))).drop(X, "centre", "scale")


def dominant_periods(df: DataFrame, factor: int = 1) -> DataFrame:
    """(…, rank, delay, weight) of the strongest delays of the circular autocorrelation, one row each."""
    keep = [c for c in df.columns if c != X]
    out = df.withColumn("_p", S.strongest_delays(F.col(X), factor))
    out = out.select(*keep, F.posexplode(F.arrays_zip("_p.delay", "_p.weight")).alias("rank", "p"))
    return out.select(*keep, "rank", F.col("p.delay").alias("delay"), F.col("p.weight").alias("weight"))


def delay_aggregate(df: DataFrame, factor: int = 1) -> DataFrame:
    """Adds ``aggregated``: the weighted sum of the series rolled by each of its strongest delays."""
    return df.withColumn("aggregated", S.delay_aggregated(F.col(X), factor))
