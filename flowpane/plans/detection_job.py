"""Windows to scores, a threshold and an evaluation, without labels in training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.operators import metrics, scores, series, thresholds
from flowpane.operators.window_features import rfft_amplitude
from flowpane.plans.window_job import WindowSet
from flowpane.session import materialise

KEY = ("source", "window_id", "split", "is_malicious")


def score_windows(windows: WindowSet, features: Sequence[str], trend: str = "ema") -> DataFrame:
    """(source, window_id, split, label, recon_score, freq_score, fused_score), ranks fused within each split.

    Reconstruction error is what a trend plus seasonal decomposition leaves; the frequency score compares spectra
    with those of the normal training windows.
    """
    s = rfft_amplitude(series.decompose(windows.series(features), trend))
    s = materialise(s.select(*KEY, "channel", "residual", "amp"))
    base = scores.spectral_baseline(s.where("split = 'train' and is_malicious = 0"))
    both = scores.residual_score(s, KEY).join(scores.freq_score(s, base, KEY), list(KEY))
    both = both.where("split <> 'train' or is_malicious = 0").withColumnRenamed("is_malicious", "label")
    return scores.rank_fuse(materialise(both), ["recon_score", "freq_score"])


def detection_report(scored: DataFrame, q: float = 0.95, risk: float = 1e-5) -> DataFrame:
    """(rule, threshold, f1, precision, recall, auc_roc, auc_pr) on the test split, for the threshold from the tail
    of normal val scores, from the val grid, and the best one for test itself."""
    val, test = scored.where("split = 'val'"), scored.where("split = 'test'")
    cuts = {"pot": thresholds.pot_threshold(val.where("label = 0"), "fused_score", q, risk).first()["threshold"],
            "val_grid": thresholds.best_f1(val, "fused_score").first()["threshold"],
            "test_best": thresholds.best_f1(test, "fused_score").first()["threshold"]}
    rank = metrics.ranking_metrics(test, "fused_score").first()
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(float(v)).alias("threshold")) for k, v in cuts.items()]))
    judged = test.select("label", "fused_score", rules.alias("r")).select(
        "label", "r.rule", "r.threshold", (F.col("fused_score") > F.col("r.threshold")).cast("int").alias("pred"))
    return metrics.prf(judged, by=["rule", "threshold"]).drop("accuracy").withColumns(
        {"auc_roc": F.lit(rank["auc_roc"]), "auc_pr": F.lit(rank["average_precision"])})
