"""Differences between two groups of rows: moments, empirical distributions, spectra, verdicts (``discrepancy`` has kernels).

The input is tall: key columns (feature, bin, ...), a ``value`` and a ``side`` ('a' or 'b'). All keys are handled in
one job. Distribution distances first merge equal values, then run along the ordered values of all keys at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpane.functions import numbers as N
from flowpane.functions.signal import gaussian_weights
from flowpane.operators.ordered import running_totals
from flowpane.session import materialise


def window_values(series: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Flow rows of window series, with their multiplicity: (keep, feature, value)."""
    return series.select(*keep, F.col("channel").alias("feature"), F.explode("x").alias("value"))


def counted_vectors(windows: DataFrame, keep: Sequence[str], number: str = "n") -> DataFrame:
    """Flow rows of windows with ``vectors``, equal ones once: (keep, vector, number). A row stands in several windows, most of which
    are alike in ``keep`` and in one task, so few rows leave it."""
    rows = windows.select(*keep, F.explode("vectors").alias("vector"))
    return rows.groupBy(*keep, "vector").agg(F.count(F.lit(1)).alias(number))


def two_sides(df: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """Keep the rows of groups ``a`` and ``b`` of a column, as sides."""
    side = F.when(F.col(column) == a, "a").when(F.col(column) == b, "b")
    return df.withColumn("side", side).where("side is not null")


def feature_moments(tall: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis (population forms) of both sides, and their gaps."""
    g = tall.groupBy(*by, "side").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))
    names = ("mean", "std", "skew", "kurtosis")
    wide = g.groupBy(*by).agg(*[F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{n}_{s}")
                                for s in ("a", "b") for n in names])
    return wide.withColumns({"mean_gap": F.abs(F.col("mean_a") - F.col("mean_b")),
                             "std_ratio": F.col("std_b") / (F.col("std_a") + 1e-10)})


def distribution_distances(tall: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by, ks, wasserstein, n_a, n_b): two-sample Kolmogorov-Smirnov statistic and 1-D Wasserstein distance."""
    is_side = lambda s: F.sum((F.col("side") == s).cast("bigint"))
    counts = tall.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        is_side("a").alias("a"), is_side("b").alias("b"))
    runs = running_totals(counts, by, ["value"], ["a", "b"], following="value")
    gap = F.abs(F.try_divide(F.col("a_cum"), F.col("a_all")) - F.try_divide(F.col("b_cum"), F.col("b_all")))
    step = F.coalesce(F.col("value_next") - F.col("value"), F.lit(0.0))
    return runs.groupBy(*by).agg(F.max(gap).alias("ks"), F.sum(gap * step).alias("wasserstein"),
                                 F.max("a_all").alias("n_a"), F.max("b_all").alias("n_b"))


def ks_pvalue(stat: Column, n: Column, m: Column) -> Column:
    """Limit distribution of the statistic, 100 terms; 1 where the series has not begun to fall."""
    lam2 = stat * stat * (n.cast("double") * m / (n + m))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(
        k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0)))


def with_significance(distances: DataFrame, level: float = 0.05) -> DataFrame:
    p = ks_pvalue(F.col("ks"), F.col("n_a"), F.col("n_b"))
    return distances.withColumn("p_value", p).withColumn("significant", F.col("p_value") < level)


def mmd_outliers(mmds: DataFrame) -> DataFrame:
    """Flags features whose discrepancy is more than one deviation above the mean. One row per feature."""
    w = Window.partitionBy()
    return mmds.withColumn("outlier", F.col("mmd") > F.avg("mmd").over(w) + F.stddev_pop("mmd").over(w))


# ---- verdicts ------------------------------------------------------------------------------------------------------

def label_shift(split_meta: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """One row: malicious windows and shares of two splits, and the gap between the shares."""
    s = lambda name: F.col("split") == name
    counts = [e for side, name in (("a", a), ("b", b)) for e in (
        F.count_if(s(name)).alias(f"total_{side}"), F.count_if(s(name) & (F.col("is_malicious") == 1)).alias(f"positive_{side}"))]
    g = split_meta.agg(*counts)
    g = g.withColumns({f"ratio_{x}": N.ratio(F.col(f"positive_{x}"), F.col(f"total_{x}")) for x in ("a", "b")})
    return g.withColumn("ratio_gap", F.abs(F.col("ratio_a") - F.col("ratio_b")))


def mmd_band(m: Column) -> Column:
    return F.when(m > 0.1, "significant").when(m > 0.01, "moderate").otherwise("minor")


def _top(df: DataFrame, col: str, section: str, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.desc(col), "feature"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.lit(section).alias("section"), "rank", F.col("feature").alias("item"), F.col(col).alias("value"))


def shift_report(distances: DataFrame, global_mmd: DataFrame, labels: DataFrame, feature_mmd: DataFrame) -> DataFrame:
    """(section, rank, item, value): verdicts on discrepancy, labels and features, and the ten most shifted features.

    Inputs are report tables: one row, or one row per feature. ``distances`` has ``significant``.
    """
    ks = distances.agg(F.count_if("significant").alias("sig"), F.count(F.lit(1)).alias("total")).first()
    m = global_mmd.first()["mmd"]
    gap = labels.first()["ratio_gap"]
    share = ks["sig"] / ks["total"] if ks["total"] else 0.0
    if share > 0.5 and m > 0.05:
        conclusion = "significant: natural drift is sufficient"
    elif share > 0.3:
        conclusion = "moderate: combine natural and synthetic drift"
    else:
        conclusion = "minor: construct synthetic drift"
    band = "significant" if m > 0.1 else "moderate" if m > 0.01 else "minor"
    facts = [("mmd", 1, band, float(m)), ("labels", 1, "warning" if gap > 0.1 else "stable", float(gap)),
             ("ks_summary", 1, f"{ks['sig']}/{ks['total']} features", float(share)), ("conclusion", 1, conclusion, None)]
    head = distances.sparkSession.createDataFrame(facts, "section string, rank int, item string, value double")
    return head.unionByName(_top(distances, "ks", "top_ks")).unionByName(_top(feature_mmd, "mmd", "top_mmd"))


def as_pairs(tall: DataFrame) -> DataFrame:
    """Rows with ``split`` and ``is_malicious`` in the comparisons A (normal train, all test) and B (normal train,
    normal test): adds ``pair`` and ``side``."""
    train = (F.col("split") == "train") & (F.col("is_malicious") == 0)
    test = F.col("split") == "test"
    homes = (F.when(train, F.array(*[F.struct(F.lit(p).alias("pair"), F.lit("a").alias("side")) for p in "AB"]))
             .when(test & (F.col("is_malicious") == 0), F.array(*[
                 F.struct(F.lit(p).alias("pair"), F.lit("b").alias("side")) for p in "AB"]))
             .when(test, F.array(F.struct(F.lit("A").alias("pair"), F.lit("b").alias("side")))))
    out = tall.withColumn("_p", F.explode(homes))
    return out.withColumns({"pair": F.col("_p.pair"), "side": F.col("_p.side")}).drop("_p")


def drift_sources(pair_distances: DataFrame) -> DataFrame:
    """Per feature: statistic in A and B, their difference, and where the drift comes from."""
    pick = lambda p, c: F.max(F.when(F.col("pair") == p, F.col(c)))
    g = pair_distances.groupBy("feature").agg(pick("A", "ks").alias("ks_a"), pick("B", "ks").alias("ks_b"))
    diff = F.col("ks_a") - F.col("ks_b")
    source = (F.when((F.col("ks_b") > 0.1) & (F.col("diff") < 0.05), "Covariate")
              .when(F.col("diff") > 0.1, "Anomaly").otherwise("Mixed"))
    return g.withColumn("diff", diff).withColumn("source", source)


def drift_verdict(pair_mmd: DataFrame, pair_distances: DataFrame) -> DataFrame:
    """One row: discrepancy of A, of B, their difference, and what the anti-drift work should aim at."""
    pick = lambda p: F.max(F.when(F.col("pair") == p, F.col("mmd")))
    sig = pair_distances.where("pair = 'B'").agg(
        N.ratio(F.count_if("significant"), F.count(F.lit(1))).alias("s")).first()["s"]
    g = pair_mmd.agg(pick("A").alias("mmd_a"), pick("B").alias("mmd_b"))
    advice = (F.when((F.col("mmd_b") > 0.05) & F.lit(sig > 0.5), "adapt the reconstruction baseline")
              .when(F.col("mmd_a") > 0.05, "adapt the threshold").otherwise("add synthetic drift"))
    return g.withColumns({"mmd_diff": F.col("mmd_a") - F.col("mmd_b"),
                          "normal_drifts": F.col("mmd_b") > 0.05, "advice": advice}).withColumn(
        "anomalies_matter", F.col("mmd_diff") > 0.03)


# ---- spectra -------------------------------------------------------------------------------------------------------

def spectral_drift(spectra: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per frequency bin: distances between the sides' log-amplitudes, pooled over windows and channels.

    ``spectra`` has ``amp`` arrays and ``side``; further ``by`` columns (a data set name) are compared apart.
    """
    tall = spectra.select(*by, "side", F.posexplode("amp").alias("bin", "value"))
    return distribution_distances(tall, [*by, "bin"])


def common_bins(curves: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Curves of several data sets cut to the bins that all of them have. A curve has one row per bin."""
    last = curves.groupBy(dataset).agg(F.max("bin").alias("m")).agg(F.min("m").alias("m")).first()["m"]
    return curves.where(F.col("bin") <= last)


def band_summary(curve: DataFrame, col: str, bins: int, low: float = 0.2, high: float = 0.2,
                 by: Sequence[str] = ()) -> DataFrame:
    """Mean of a per-bin curve overall, in the lowest and in the highest bins, and the ratio low / high."""
    c = F.col(col)
    g = curve.groupBy(*by).agg(
        F.avg(c).alias("overall"), F.avg(F.when(F.col("bin") < int(bins * low), c)).alias("low"),
        F.avg(F.when(F.col("bin") >= int(bins * (1.0 - high)), c)).alias("high"))
    return g.withColumn("low_high_ratio", F.col("low") / (F.col("high") + 1e-12))


def drift_histograms(tall: DataFrame, distances: DataFrame, k: int = 6, bins: int = 80) -> DataFrame:
    """(feature, side, bin, left, n, density) of the ``k`` most shifted features, both sides on one range."""
    top = materialise(distances.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("ks"), "feature")))
                      .where(F.col("_r") <= k).select("feature"))
    rows = tall.join(top, "feature")
    ranges = materialise(rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    rows = rows.join(ranges, "feature")
    slot = N.equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins)
    g = rows.groupBy("feature", "side", slot.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    total = F.sum("n").over(Window.partitionBy("feature", "side"))
    return g.select("feature", "side", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "n",
                    F.coalesce(F.try_divide(F.col("n"), total * width), F.lit(0.0)).alias("density"))


def curve_association(curves: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation and least-squares line of two per-bin curves in one table."""
    def rank(c):
        w = Window.orderBy(c)
        ties = F.count(F.lit(1)).over(Window.partitionBy(c))
        return F.rank().over(w) + (ties - 1) / 2.0
    r = curves.withColumns({"_rx": rank(x), "_ry": rank(y)})
    return r.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"),
                 F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def precision_weights(curve: DataFrame, col: str, by: Sequence[str] = (), sigma: float = 0.7, ramp_from: int = 20,
                      ramp: float = 0.18) -> DataFrame:
    """(by, bin, smooth, weight): exp(-s) of a per-bin curve after Gaussian smoothing (edges reflected) and a
    quadratic ramp over the upper bins. A curve is as long as a spectrum."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    n = F.max("bin").over(Window.partitionBy(*by)) + 1
    sized = materialise(curve).select(*by, "bin", F.col(col).alias("s"), n.alias("n"))
    # each bin looks at the bins around it; past an edge the curve is reflected: ... 1 0 | 0 1 ... n-1 | n-1 n-2 ...
    hits = F.array(*[F.struct((F.col("bin") + d).alias("at"), F.lit(v).alias("w")) for d, v in zip(range(-r, r + 1), w)])
    i, n = F.col("h.at"), F.col("n")
    mirrored = F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)
    near = sized.withColumn("h", F.explode(hits)).select(*by, F.col("bin"), "n", mirrored.alias("src"), F.col("h.w").alias("w"))
    values = sized.select(*by, F.col("bin").alias("src"), "s")
    smooth = near.join(values, [*by, "src"]).groupBy(*by, "bin").agg(
        F.sum(F.col("w") * F.col("s")).alias("v"), F.max("n").alias("n"))
    place = (F.col("bin") - ramp_from) / (F.col("n") - 1 - ramp_from)
    up = F.when((F.col("bin") >= ramp_from) & (F.col("n") - 1 > ramp_from), ramp * place * place).otherwise(0.0)
    out = smooth.select(*by, "bin", (F.col("v") + up).alias("smooth"))
    return out.withColumn("weight", F.exp(-F.col("smooth")))


def band_weight(bin_: Column, bins: int, low_w: float = 0.2, mid_w: float = 1.0, high_w: float = 0.6,
                low_end: float = 0.10, mid_start: float = 0.18, mid_end: float = 0.28,
                high_start: float = 0.55) -> Column:
    """Piecewise-linear weight of a frequency bin: low, rising, middle, falling, high; 0 for the DC bin."""
    f = bin_ / F.lit(float(bins - 1))
    rise = low_w + (f - low_end) / (mid_start - low_end) * (mid_w - low_w)
    fall = mid_w + (f - mid_end) / (high_start - mid_end) * (high_w - mid_w)
    return (F.when(bin_ == 0, 0.0).when(f <= low_end, low_w).when(f < mid_start, rise).when(f <= mid_end, mid_w)
            .when(f < high_start, fall).otherwise(high_w))
