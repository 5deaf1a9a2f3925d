"""Statistics, spectra, pooling and scaling of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpane.functions import signal as S
from flowpane.operators.sampling import HASH_RANGE, sample_hash
from flowpane.operators.windows import WindowSpec, pane_windows, window_rows

STATS = ("mean", "std", "max", "min", "median", "last")


def window_stats(df: DataFrame, spec: WindowSpec, features: Sequence[str],
                 stats: Sequence[str] = ("mean", "std", "max", "min")) -> DataFrame:
    """``<feature>_<stat>`` per window, from pane statistics.

    The panes of a window have equal length, so its mean is the mean of pane means, and its population variance the
    mean pane variance plus the variance of the pane means: no sums of squares, no cancellation. Only ``median``
    needs the rows.
    """
    pane: dict[str, Column] = {}
    win: dict[str, Column] = {}
    post: dict[str, Column] = {}
    for f in features:
        c = F.col(f)
        if {"mean", "std"} & set(stats):
            pane[f"{f}__a"] = F.avg(c)
        if "mean" in stats:
            win[f"{f}_mean"] = F.avg(f"{f}__a")
        if "std" in stats:
            pane[f"{f}__v"] = F.var_pop(c)
            win[f"{f}__va"], win[f"{f}__vm"] = F.avg(f"{f}__v"), F.var_pop(f"{f}__a")
            post[f"{f}_std"] = F.sqrt(F.col(f"{f}__va") + F.col(f"{f}__vm"))
        if "max" in stats:
            pane[f"{f}__x"], win[f"{f}_max"] = F.max(c), F.max(f"{f}__x")
        if "min" in stats:
            pane[f"{f}__n"], win[f"{f}_min"] = F.min(c), F.min(f"{f}__n")
        if "last" in stats:
            pane[f"{f}__l"], win[f"{f}_last"] = F.max_by(c, "pos"), F.last(f"{f}__l")
        if "median" in stats:
            pane[f"{f}__m"], win[f"{f}_median"] = F.collect_list(c), F.collect_list(f"{f}__m")
            s = F.sort_array(F.flatten(f"{f}_median"))
            post[f"{f}_median"] = (F.element_at(s, F.lit((spec.size + 1) // 2))
                                   + F.element_at(s, F.lit(spec.size // 2 + 1))) / 2
    out = pane_windows(df, spec, pane, win, whole_rows="median" in stats, post=post or None)
    return out.select(spec.source, "window_id", *[f"{f}_{s}" for s in stats for f in features])


def window_vector(df: DataFrame, spec: WindowSpec, features: Sequence[str]) -> DataFrame:
    """``x``: the size * features values of a window, row after row."""
    rows = window_rows(df, spec, features)
    flat = F.flatten(F.transform("rows", lambda r: F.array(*[r[f] for f in features])))
    return rows.select(spec.source, "window_id", flat.alias("x"))


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, sd) with the population deviation; a constant feature gets sd 1."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in features])
    tall = one.unpivot([], list(features), "feature", "s")
    return tall.select("feature", "s.mean", F.coalesce(F.nullif(F.col("s.sd"), F.lit(0.0)), F.lit(1.0)).alias("sd"))


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardise the features named in ``stats``; one row per feature comes to the driver as constants."""
    return df.withColumns({r["feature"]: (F.col(r["feature"]) - r["mean"]) / r["sd"] for r in stats.collect()})


def instance_norm(series: DataFrame, mode: str = "mean", eps: float = 1e-5, unbiased: bool = False) -> DataFrame:
    """Centre each window and channel on its mean (or last value) and divide by sqrt(variance + eps).

    ``centre`` and ``scale`` stay with the row for :func:`instance_denorm`.
    """
    if mode not in ("mean", "last"):
        raise ValueError(f"unknown mode {mode!r}")
    keep = [c for c in series.columns if c != "x"]
    return series.withColumn("_z", S.standardised(F.col("x"), mode, eps, unbiased)).select(*keep, "_z.x", "_z.centre", "_z.scale")


def instance_denorm(series: DataFrame) -> DataFrame:
    return series.withColumn("x", S.restored(F.col("x"), F.col("centre"), F.col("scale"))).drop("centre", "scale")


def rfft_amplitude(series: DataFrame, log1p: bool = True) -> DataFrame:
    """Adds ``amp``: (log) amplitude per frequency bin."""
    return series.withColumn("amp", S.amplitude(F.col("x"), log1p))


def rfft_phase(series: DataFrame) -> DataFrame:
    """Adds ``phase``: null where the amplitude is about 0."""
    return series.withColumn("phase", F.transform(S.phase(F.col("x")), lambda p: F.when(~F.isnan(p), p)))


def by_bin(spectra: DataFrame, col: str = "amp", out: str = "amp") -> DataFrame:
    """Long form: one row per (window, channel, bin)."""
    keep = [c for c in spectra.columns if c not in (col, "x")]
    return spectra.select(*keep, F.posexplode(col).alias("bin", out))


def multiscale_pool(series: DataFrame, scales: Sequence[int] = (8, 4, 2), beta: float = 0.7) -> DataFrame:
    """(…, scale, pooled STRUCT<avg, max, hybrid, mean, std, top>): arrays over the non-overlapping pools of each
    scale, a short last pool dropped, and statistics of (avg + max) / 2."""
    keep = [c for c in series.columns if c != "x"]
    out = series.withColumns({f"_p{k}": S.pooled(F.col("x"), k, beta) for k in scales})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(f"_p{k}").alias("pooled")) for k in scales]))
    return out.select(*keep, each.alias("p")).select(*keep, "p.scale", "p.pooled")


def multiscale_stats(pooled: DataFrame) -> DataFrame:
    """Mean, sample deviation and maximum of (avg + max) / 2 per scale."""
    keep = [c for c in pooled.columns if c != "pooled"]
    return pooled.select(*keep, "pooled.mean", "pooled.std", F.col("pooled.top").alias("max"))


def rolling_segment(bin_: Column, bins: int, segments: int) -> Column:
    """Number of the segment that masks a bin: bins 1.. are cut in chunks of equal, rounded-up length; DC in none."""
    length = -(-(bins - 1) // segments)
    return F.when(bin_ > 0, F.floor((bin_ - 1) / length).cast("int"))


def mask_bins_random(spectra: DataFrame, key: Sequence[str], bins: int, seed: int, low: float = 0.2,
                     high: float = 0.5) -> DataFrame:
    """Adds ``masked_bins`` and ``amp_masked``: a share of the bins drawn from U(low, high) per window, DC kept.

    The draw depends on the window and the seed only, so all channels of a window share it.
    """
    name = F.concat_ws("/", *key)
    ratio = low + (high - low) * sample_hash(name, seed) / HASH_RANGE
    k = F.bround(ratio * (bins - 1)).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda b: F.struct(
        sample_hash(F.concat_ws("#", name, b), seed).alias("h"), b.alias("b")))
    picked = F.sort_array(F.slice(F.sort_array(drawn), F.lit(1), k).getField("b"))
    out = spectra.withColumn("masked_bins", picked)
    return out.withColumn("amp_masked", F.transform(
        "amp", lambda a, i: F.when(F.array_contains("masked_bins", i), 0.0).otherwise(a)))


def stack_features(features: Sequence[str]) -> Column:
    """Array of (feature, value) for turning wide rows tall in one pass."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])


def tall(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(stack_features(features)).alias("e")).select(*keep, "e.feature", "e.value")

