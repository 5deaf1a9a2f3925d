"""Thresholds for scores: a row is predicted anomalous when its score is above the threshold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpane.operators.metrics import f1_at
from flowpane.operators.ordered import exact_quantiles, null_safe_join
from flowpane.session import materialise


def threshold_percentile(df: DataFrame, score: str, percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, percent, threshold)."""
    q = exact_quantiles(df, by, score, [p / 100 for p in percents])
    return q.select(*by, F.round(F.col("prob") * 100, 9).alias("percent"), F.col("value").alias("threshold"))


def predict(df: DataFrame, score: str, threshold: Column) -> DataFrame:
    return df.withColumn("pred", (F.col(score) > threshold).cast("int"))


def _best(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best F1 over a grid of thresholds, from rows (by, above, n, pos): ``above`` is how many grid thresholds a
    score exceeds. A group has at most one row per grid step. Thresholds with no score between them predict the
    same, so the first of each such stretch stands for it.
    """
    up = Window.partitionBy(*by).orderBy("above")
    down = Window.partitionBy(*by).orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, 0)
    t = binned.withColumns({
        "i": F.coalesce(F.lag("above").over(up), F.lit(0)), "tp": F.sum("pos").over(down),
        "hit": F.sum("n").over(down), "actual": F.sum("pos").over(Window.partitionBy(*by))})
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("hit") + F.col("actual")), F.lit(0.0))
    t = t.withColumn("f1", F.when(F.col("above") > 0, f1).otherwise(0.0))
    best = F.max_by(F.struct("i", "tp", "hit", "actual", "f1"), F.struct(F.col("f1"), -F.col("i")))
    return t.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def _finish(best: DataFrame, by: Sequence[str], threshold: Column) -> DataFrame:
    some = F.col("f1") > 0
    part = lambda den: F.coalesce(F.try_divide(F.col("tp").cast("double"), den.cast("double")), F.lit(0.0))
    return best.select(
        *by, F.when(some, threshold).otherwise(0.0).alias("threshold"), F.col("f1").alias("f1_star"),
        F.when(some, part(F.col("hit"))).otherwise(0.0).alias("precision"),
        F.when(some, part(F.col("actual"))).otherwise(0.0).alias("recall"))


def best_f1(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = (), n_steps: int = 1000) -> DataFrame:
    """(by, threshold, f1_star, precision, recall): best of ``n_steps`` evenly spaced thresholds between the smallest
    and the largest score, the first among equals; all zero when no threshold gives a positive F1.

    Each score finds its place in the grid by arithmetic, so the work is linear in the rows and the shuffle carries
    one row per grid step and map task.
    """
    by = list(by)
    ranges = df.groupBy(*by).agg(F.min(score).cast("double").alias("_lo"), F.max(score).cast("double").alias("_hi"))
    if by:
        ranges = materialise(ranges)
        rows = null_safe_join(df, ranges, by)
    else:
        r = ranges.first()
        rows = df.withColumns({"_lo": F.lit(r["_lo"]), "_hi": F.lit(r["_hi"])})
    s, lo, hi = F.col(score).cast("double"), F.col("_lo"), F.col("_hi")
    step = (hi - lo) / (n_steps - 1)
    at = lambda i: F.when(i >= n_steps - 1, hi).otherwise(i * step + lo)
    g = F.least(F.greatest(F.floor(F.coalesce(F.try_divide(s - lo, step), F.lit(0.0))), F.lit(0)), F.lit(n_steps - 1))
    rows = rows.withColumn("_g", g)
    g = F.col("_g")
    above = (F.when(at(g) < s, F.when((g + 1 < n_steps) & (at(g + 1) < s), g + 2).otherwise(g + 1))
             .otherwise(F.when((g > 0) & (at(g - 1) < s), g).otherwise(F.greatest(g - 1, F.lit(0)))))
    binned = rows.where(F.col(score).isNotNull()).groupBy(*by, above.cast("int").alias("above")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    best = _best(binned, by)
    if by:
        best = null_safe_join(best, ranges, by)
    else:
        best = best.withColumns({"_lo": F.lit(r["_lo"]), "_hi": F.lit(r["_hi"])})
    return _finish(best, by, at(F.col("i")))


def best_f1_percentile(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = (), lo: float = 50.0,
                       hi: float = 99.9, n_steps: int = 100) -> DataFrame:
    """Like :func:`best_f1` on a grid of score percentiles."""
    by = list(by)
    probs = [float(p) / 100 for p in np.linspace(lo, hi, n_steps)]
    q = exact_quantiles(df, by, score, probs)
    grids = q.groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("_grid")).collect()  # a row per report group
    table = np.array([[float(v) for v in r["_grid"]] for r in grids])
    kinds = dict(df.dtypes)
    names = df.sparkSession.createDataFrame(
        [(*[r[c] for c in by], i, [float(v) for v in r["_grid"]]) for i, r in enumerate(grids)],
        ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_gid int", "_grid array<double>"]))

    def above(s: pd.Series, gid: pd.Series) -> pd.Series:
        out = np.zeros(len(s), dtype=np.int32)
        for g in np.unique(gid):
            at = (gid == g).to_numpy()
            out[at] = np.searchsorted(table[g], s.to_numpy()[at], side="left")
        return pd.Series(out)

    slim = df.where(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("_s"), F.col(label).alias("_y"))
    ids = names.drop("_grid")
    rows = null_safe_join(slim, F.broadcast(ids), by) if by else slim.withColumn("_gid", F.lit(0))
    binned = rows.groupBy(*by, F.pandas_udf(above, "int")("_s", "_gid").alias("above")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    best = _best(binned, by)
    best = null_safe_join(best, names, by) if by else best.withColumn("_grid", F.array(*[F.lit(float(v)) for v in table[0]]))
    return _finish(best, by, F.element_at("_grid", (F.col("i") + 1).cast("int")))


# ---- peaks over threshold ------------------------------------------------------------------------------------------

def _fit_moments(y: DataFrame) -> tuple[float, float]:
    r = y.agg(F.avg("y").alias("m"), F.var_samp("y").alias("v")).first()
    k = r["m"] * r["m"] / r["v"]
    return 0.5 * (1 - k), 0.5 * r["m"] * (k + 1)


def _fit_likelihood(y: DataFrame, points: int = 48, rounds: int = 5) -> tuple[float, float]:
    """Maximum-likelihood generalised Pareto fit with location 0, by the profile over theta = shape / scale.

    For a given theta the best shape is mean(log(1 + theta y)); the profile is evaluated for a whole grid of thetas
    in one aggregate over the exceedances, and the grid is narrowed around the best point.
    """
    r = y.agg(F.avg("y").alias("m"), F.max("y").alias("x")).first()
    mean, top = r["m"], r["x"] / r["m"]
    lower = -1.0 / top
    grid = np.concatenate([lower * (1 - np.geomspace(1e-4, 0.999, points // 2)),
                           np.geomspace(1e-4, 1e3, points // 2)])
    best = (0.0, 0.0, -1.0)  # theta, shape, profile: the exponential case
    for _ in range(rounds):
        grid = np.unique(grid[(grid > lower) & (np.abs(grid) > 1e-9)])
        row = y.agg(*[F.avg(F.log1p(F.col("y") / mean * float(t))).alias(f"k{i}") for i, t in enumerate(grid)]).first()
        shape = np.array([row[f"k{i}"] for i in range(len(grid))])
        with np.errstate(divide="ignore", invalid="ignore"):
            profile = -np.log(shape / grid) - shape - 1
        profile[~np.isfinite(profile) | (shape <= -1)] = -np.inf
        i = int(np.argmax(profile))
        if profile[i] > best[2]:
            best = (float(grid[i]), float(shape[i]), float(profile[i]))
        left, right = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
        grid = np.linspace(left, right, points)
    theta, shape, _profile = best
    return (0.0, mean) if theta == 0.0 else (shape, shape / theta * mean)


def pot_threshold(df: DataFrame, score: str, q: float = 0.98, risk: float = 1e-4, max_xi: float = 1.0,
                  fit: str = "mle", min_exceedances: int = 10) -> DataFrame:
    """One row: the threshold exceeded with probability ``risk`` under a generalised Pareto tail above quantile ``q``.

    ``fit``: 'mle' or 'moments'. Fewer than ``min_exceedances`` exceedances, or only equal ones, have no tail to fit: the
    threshold is the quantile itself, and ``xi`` and ``sigma`` are null. Without scores all but the counts is null. The
    shape is capped at ``max_xi`` and the threshold at three times the largest score.
    """
    quantile = exact_quantiles(df, [], score, [q]).first()
    t = quantile["value"] if quantile else None
    over = F.when(F.col(score) > t, F.col(score))
    facts = df.agg(F.count(score).alias("n"), F.count(over).alias("m"), F.min(over).alias("low"), F.max(score).alias("top")).first()
    xi = sigma = None
    threshold = t
    if facts["m"] >= min_exceedances and facts["low"] < facts["top"]:
        y = materialise(df.where(F.col(score) > t).select((F.col(score) - t).alias("y")))
        xi, sigma = _fit_moments(y) if fit == "moments" else _fit_likelihood(y)
        xi = min(xi, max_xi)
        tail = facts["m"] / (facts["n"] * risk)
        threshold = t + (sigma * float(np.log(tail)) if abs(xi) < 1e-8 else sigma / xi * (tail ** xi - 1))
        threshold = min(threshold, facts["top"] * 3.0)
    return df.sparkSession.createDataFrame(
        [(None if t is None else float(threshold), None if t is None else float(t), xi, sigma, int(facts["m"]), int(facts["n"]))],
        "threshold double, initial double, xi double, sigma double, exceedances bigint, n bigint")


def threshold_transfer(val: DataFrame, test: DataFrame, score: str, label: str = "label", n_steps: int = 1000) -> DataFrame:
    """One row: the threshold chosen on val, its F1 on test, the best threshold on test, its F1, and the loss."""
    tau = best_f1(val, score, label, n_steps=n_steps).first()["threshold"]
    oracle = best_f1(test, score, label, n_steps=n_steps).first()
    deployed = f1_at(test, score, label, tau)
    return deployed.select(
        F.lit(float(tau)).alias("threshold_val"), F.col("f1").alias("f1_test"),
        F.lit(float(oracle["threshold"])).alias("threshold_test"), F.lit(float(oracle["f1_star"])).alias("f1_star"),
        (F.lit(float(oracle["f1_star"])) - F.col("f1")).alias("delta"))
