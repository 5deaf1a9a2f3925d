"""Detection by attack type: which attacks a window contains and how many such windows were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.functions import numbers as N
from flowpane.operators.metrics import sorted_by_rate
from flowpane.operators.ordered import exact_quantiles, null_safe_join
from flowpane.session import materialise

GID = "global_window_id"


def attacks_of(counts: Column, primary: Column, listed: Column | None = None) -> Column:
    """Attack names of a window: those listed, those counted more than 0 times, and only without any the primary one."""
    clean = lambda names: F.filter(F.transform(names, L.normalise_attack), lambda a: a.isNotNull())
    counted = F.transform(F.filter(F.map_entries(counts), lambda e: e["value"] > 0), lambda e: e["key"])
    many = F.coalesce(counted, F.array().cast("array<string>"))
    if listed is not None:
        many = F.concat(F.coalesce(listed, F.array().cast("array<string>")), many)
    names = F.sort_array(F.array_distinct(clean(many)))
    return F.when(F.size(names) > 0, names).otherwise(clean(F.array(primary)))


def with_attacks(meta: DataFrame) -> DataFrame:
    return meta.withColumn("attacks", attacks_of(F.col("attack_types"), F.col("primary_attack")))


def align(pred: DataFrame, meta: DataFrame, key: str = GID) -> DataFrame:
    """Predictions with their window's metadata; an error if either side has windows the other lacks."""
    both = materialise(pred.withColumn("_p", F.lit(1)).join(meta.withColumn("_m", F.lit(1)), key, "full"))
    odd = both.agg(F.count_if(F.col("_p").isNull()).alias("p"), F.count_if(F.col("_m").isNull()).alias("m")).first()
    if odd["p"] or odd["m"]:
        raise ValueError(f"{odd['p']} windows without a prediction, {odd['m']} predictions without a window")
    return both.drop("_p", "_m")


def attack_recall(aligned: DataFrame, pred: str = "pred", prob: str = "prob", pure: bool = False) -> DataFrame:
    """Per attack type: windows containing it, found, missed, rate, mean and median probability, place by rate.

    A window counts once for every attack it contains; ``pure`` keeps windows of exactly one. Malicious windows whose
    attack is not known count as Unknown (not under ``pure``).
    """
    bad = aligned.where("is_malicious = 1")
    if pure:
        names = F.when(F.size("attacks") == 1, F.col("attacks"))
    else:
        names = F.when(F.size("attacks") > 0, F.col("attacks")).otherwise(F.array(F.lit("Unknown")))
    rows = bad.select(F.explode(names).alias("attack"), F.col(pred).alias("pred"), F.col(prob).cast("double").alias("prob"))
    g = rows.groupBy("attack").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("pred") == 1).alias("tp"),
        F.count_if(F.col("pred") == 0).alias("fn"), F.avg("prob").alias("mean_prob"))
    med = exact_quantiles(rows, ["attack"], "prob", [0.5]).select("attack", F.col("value").alias("median_prob"))
    out = null_safe_join(g, med, ["attack"], "left").withColumn("detection_rate", N.ratio(F.col("tp"), F.col("count")))
    return sorted_by_rate(out, "detection_rate", "attack")


def attack_set_stats(meta: DataFrame) -> DataFrame:
    """(statistic, n): benign, malicious, mixed and unknown windows, and the sizes of the attack sets."""
    bad = F.col("is_malicious") == 1
    size = F.size("attacks")
    per = meta.groupBy(F.when(bad, size).otherwise(-1).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("k")
    names = F.concat(F.array(F.when(k < 0, "benign_windows").otherwise("malicious_windows")),
                     F.when(k > 1, F.array(F.lit("mixed_windows"))).when(k == 0, F.array(F.lit("unknown_windows")))
                     .otherwise(F.array().cast("array<string>")),
                     F.when(k >= 0, F.array(F.concat(F.lit("attack_set_size_"), k))).otherwise(F.array().cast("array<string>")))
    return per.select(F.explode(names).alias("statistic"), "n").groupBy("statistic").agg(F.sum("n").alias("n"))


def benign_accuracy(aligned: DataFrame, pred: str = "pred") -> DataFrame:
    g = aligned.where("is_malicious = 0").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col(pred) == 0).alias("correct"),
        F.count_if(F.col(pred) == 1).alias("incorrect"))
    return g.withColumn("accuracy", N.ratio(F.col("correct"), F.col("count")))

