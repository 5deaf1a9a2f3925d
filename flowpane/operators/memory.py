"""Autocorrelation of whole series, memory length, and what it says about window sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpane.functions.signal import inverse_normal
from flowpane.operators.ordered import null_safe_join, with_position
from flowpane.session import materialise


def acf(df: DataFrame, features: Sequence[str], order: Sequence[str], max_lag: int,
        by: Sequence[str] = (), min_rows: int = 2) -> DataFrame:
    """(by, feature, lag, r, n): autocorrelation of each feature in ``order``, normalised by lag 0.

    Rows are numbered, cut into blocks of consecutive rows, and each block also receives the first ``max_lag`` rows
    of the next one. A block's sums of lagged products are exact for the pairs that start in it, so adding them up
    is exact for the series, whatever its length.
    """
    by = list(by)
    placed = with_position(df.select(*by, *order, *[c for c in features if c not in order]), by, order,
                           "_pos", "_n").where(F.col("_n") >= min_rows)
    stats = placed.groupBy(*by).agg(*[F.avg(f).alias(f"_m_{f}") for f in features],
                                    *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    if by:
        z = null_safe_join(placed, materialise(stats), by)
        centre, spread = (lambda f: F.col(f"_m_{f}")), (lambda f: F.col(f"_s_{f}"))
    else:
        one = stats.first()
        z = placed
        centre, spread = (lambda f: F.lit(one[f"_m_{f}"])), (lambda f: F.lit(one[f"_s_{f}"]))
    size = max(4096, max_lag)
    block = F.floor(F.col("_pos") / size).cast("bigint")
    homes = F.when((F.col("_pos") % size < max_lag) & (F.col("_pos") >= size), F.array(block, block - 1)
                   ).otherwise(F.array(block))
    z = z.select(*by, "_pos", "_n", F.explode(homes).alias("_block"),
                 *[((F.col(f) - centre(f)) / (spread(f) + 1e-8)).alias(f) for f in features])

    def lagged_products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        own = (pdf["_pos"] // size == pdf["_block"]).to_numpy()
        out = []
        for f in features:
            v = pdf[f].to_numpy(dtype=np.float64)
            mine = v[own]
            padded = np.zeros(len(mine) + max_lag)
            padded[:min(len(v), len(padded))] = v[:len(padded)]
            part = pd.DataFrame({"lag": np.arange(max_lag + 1), "s": np.correlate(padded, mine, mode="valid")})
            out.append(part.assign(feature=f))
        frame = pd.concat(out, ignore_index=True)
        for c in (*by, "_n"):
            frame[c] = pdf[c].iloc[0]
        return frame[[*by, "feature", "lag", "s", "_n"]]

    kinds = dict(z.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "feature string", "lag int", "s double", "_n bigint"])
    parts = z.groupBy(*by, "_block").applyInPandas(lagged_products, schema)
    sums = parts.groupBy(*by, "feature", "lag").agg(F.sum("s").alias("s"), F.max("_n").alias("n")).where("lag < n")
    zero = F.first("s").over(Window.partitionBy(*by, "feature").orderBy("lag"))
    return sums.withColumn("r", F.try_divide(F.col("s"), zero)).drop("s")


def critical_value(n: Column, significance: float = 0.05) -> Column:
    return F.lit(inverse_normal(1 - significance / 2)) / F.sqrt(n)


def memory_length(acf_table: DataFrame, by: Sequence[str] = (), variant: str = "strict", max_lag: int | None = None,
                  significance: float = 0.05) -> DataFrame:
    """(by, feature, memory, critical, n) from an autocorrelation table (at most ``max_lag`` + 1 rows per series).

    ``strict``: the last significant lag before the first gap. ``tolerant``: gaps of up to five lags are bridged;
    the result is held below the first run of five lags under twice the critical value, and below max_lag / 2.
    """
    if variant == "tolerant" and max_lag is None:
        raise ValueError("the tolerant variant needs max_lag")
    key = [*by, "feature"]
    t = acf_table.withColumn("critical", critical_value(F.col("n"), significance))
    w = Window.partitionBy(*key).orderBy("lag")
    gap = 1 if variant == "strict" else 5
    significant = F.abs("r") > F.col("critical")
    # lag of the next significant row, looked up among all rows so that series without any keep a row
    nxt = F.min(F.when(significant, F.col("lag"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    ends = significant & (nxt.isNull() | (nxt - F.col("lag") > gap))
    t = t.withColumn("_end", F.when(ends, F.col("lag")))
    if variant == "strict":
        return t.groupBy(*key).agg(F.coalesce(F.min("_end"), F.lit(0)).alias("memory"),
                                   F.max("critical").alias("critical"), F.max("n").alias("n"))
    low = (F.abs("r") < 2 * F.col("critical")) & (F.col("lag") >= 1)
    run = F.sum(low.cast("int")).over(w.rowsBetween(-4, 0))
    t = t.withColumn("_quiet", F.when(run == 5, F.col("lag") - 5)).withColumn("_sig", significant)
    g = t.groupBy(*key).agg(F.min("_end").alias("a"), F.coalesce(F.min("_quiet"), F.max("lag")).alias("b"),
                            F.max("critical").alias("critical"), F.max("n").alias("n"))
    memory = F.when(F.col("a").isNull(), 0).otherwise(F.least("a", "b", F.lit(max_lag // 2)))
    return g.select(*key, memory.cast("int").alias("memory"), "critical", "n")


def memory_by_class(df: DataFrame, features: Sequence[str], order: Sequence[str], max_lag: int, label: str = "label",
                    benign: str = "Benign", variant: str = "strict") -> DataFrame:
    """Memory length of benign and of attack rows; a class of 100 rows or fewer has a null one."""
    cls = df.withColumn("class", F.when(F.col(label) == benign, "benign").otherwise("attack"))
    found = memory_length(acf(cls, features, order, max_lag, ["class"], 101), ["class"], variant, max_lag)
    every = cls.select("class").distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    return every.join(found, ["class", "feature"], "left")


def weighted_memory(memory: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean memory weighted by (feature, weight)."""
    j = memory.join(weights, "feature")
    return j.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("memory")), F.sum("weight")),
                                         F.lit(0.0)).alias("weighted_memory"))


def recommend_window(memories: DataFrame, candidates: Sequence[int], how: str = "mean") -> DataFrame:
    """(size, memory, conservative, recommended, aggressive, ratio, verdict) for each candidate window size.

    ``memories``: one row per class average and weighted mean, so a handful.
    """
    m = F.avg("memory") if how == "mean" else F.median(F.when(F.col("memory") > 0, F.col("memory")))
    one = memories.agg(m.alias("memory")).where("memory is not null")
    sized = one.select("memory", *[F.floor(F.col("memory") * k).cast("bigint").alias(n) for n, k in
                                   (("conservative", 0.8), ("recommended", 1.2), ("aggressive", 2.0))],
                       F.explode(F.array(*[F.lit(int(c)).cast("bigint") for c in candidates])).alias("size"))
    ratio = F.try_divide(F.col("size").cast("double"), F.col("recommended").cast("double"))
    verdict = (F.when(F.col("ratio").between(0.8, 1.2), "recommended")
               .when(F.col("ratio").between(0.5, 2.0), "acceptable").otherwise("not recommended"))
    return sized.withColumn("ratio", ratio).withColumn("verdict", verdict)
