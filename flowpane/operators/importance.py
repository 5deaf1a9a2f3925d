"""Tables about feature importances. Their input has one row per feature: (feature, ordinal, importance)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpane.operators.ordered import exact_quantiles, running_totals
from flowpane.operators.profile import histogram


def importance_table(imp: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``cumulative``, most important first, by name among equals. An ordered scan over ranges of rows."""
    rows = imp.withColumns({"_o": -F.col("importance"), "_one": F.lit(1)})
    t = running_totals(rows, [], ["_o", "feature"], ["importance", "_one"])
    return t.select(*imp.columns, F.col("_one_cum").cast("int").alias("rank"), F.col("importance_cum").alias("cumulative"))


def _first(imp: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of an order with their ``rank``: tasks keep ``k`` rows each before they meet."""
    return imp.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def importance_cutoffs(imp: DataFrame, thresholds: Sequence[float] = (0.5, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """(threshold, features, pct): how many top features reach each cumulative importance; 1 if none does."""
    t = importance_table(imp)
    total = F.count(F.lit(1))
    one = t.agg(total.alias("total"), *[
        F.coalesce(F.min(F.when(F.col("cumulative") >= x, F.col("rank"))), F.lit(1)).alias(f"c{i}")
        for i, x in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"c{i}").alias("features"))
                               for i, x in enumerate(thresholds)]))
    return one.select("total", rows.alias("e")).select(
        "e.threshold", "e.features", (F.col("e.features") * 100 / F.col("total")).alias("pct"))


def features_reaching(imp: DataFrame, threshold: float) -> DataFrame:
    """The features up to the cut-off, most important first."""
    t = importance_table(imp)
    cut = t.agg(F.coalesce(F.min(F.when(F.col("cumulative") >= threshold, F.col("rank"))), F.lit(1)).alias("r")).first()["r"]
    return t.where(F.col("rank") <= cut).select("rank", "feature", "importance")


def low_importance(imp: DataFrame, thresholds: Sequence[float] = (1e-4, 1e-3, 1e-2), names: int = 5) -> DataFrame:
    """(threshold, features, pct, first): features below each threshold and the first names among them."""
    below = [F.col("importance") < float(x) for x in thresholds]
    one = imp.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(below)])
    per = one.select("total", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("threshold"), F.col(f"c{i}").alias("features")) for i, x in enumerate(thresholds)])).alias("e"))
    firsts = reduce(DataFrame.unionByName, [
        _first(imp.where(c), names, F.desc("importance"), "feature").select(F.lit(i).alias("i"), "rank", "feature") for i, c in enumerate(below)])
    listed = firsts.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).getField("feature").alias("first"))
    return (per.select("e.*", "total").join(listed, "i", "left")
            .select("threshold", "features", (F.col("features") * 100 / F.col("total")).alias("pct"),
                    F.coalesce("first", F.array().cast("array<string>")).alias("first")))


def importance_stats(imp: DataFrame) -> DataFrame:
    """One row: count, mean, median, sample deviation, largest, smallest, and the 0.7 and 0.9 quantiles."""
    i = F.col("importance")
    q = {r["prob"]: r["value"] for r in exact_quantiles(imp, [], "importance", [0.5, 0.7, 0.9]).collect()}
    quantile = lambda p: F.lit(q.get(p)).cast("double")
    return imp.agg(F.count(i).alias("features"), F.avg(i).alias("mean"), F.stddev_samp(i).alias("std"), F.max(i).alias("max"),
                   F.min(i).alias("min")).select("features", "mean", quantile(0.5).alias("median"), "std", "max", "min",
                                                 quantile(0.7).alias("q70"), quantile(0.9).alias("q90"))


def importance_histogram(imp: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram whose bins are marked by where they start: above the 0.9 or the 0.7 quantile."""
    s = importance_stats(imp).first()
    level = F.when(F.col("left") > s["q90"], "top").when(F.col("left") > s["q70"], "high").otherwise("base")
    return histogram(imp, "importance", bins).withColumn("level", level)


def select_top_k(imp: DataFrame, k: int) -> DataFrame:
    """The ``k`` most important features in their original column order."""
    return _first(imp, k, F.desc("importance"), "feature").select("ordinal", "feature", "importance").orderBy("ordinal")


def select_median(imp: DataFrame) -> DataFrame:
    """Features at or above the median importance."""
    m = importance_stats(imp).first()["median"]
    return imp.where(F.col("importance") >= m)


def decode_flat(imp: DataFrame, features: int, k: int = 10) -> DataFrame:
    """(rank, idx, time_step, feature_idx, importance) of the ``k`` most important places of a flattened window."""
    return _first(imp, k, F.desc("importance"), F.desc("idx")).select(
        "rank", "idx", F.floor(F.col("idx") / features).cast("int").alias("time_step"),
        (F.col("idx") % features).cast("int").alias("feature_idx"), "importance")
