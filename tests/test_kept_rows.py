"""No row is lost to null keys, missing baselines, small classes or inputs without spread."""

import pytest

from flowpane.functions.labels import is_malicious
from flowpane.operators import attacks, forest, memory, metrics, profile, scores, thresholds
from flowpane.operators.windows import WindowSpec, integrate, source_sizes
from pyspark.sql import functions as F


def test_missing_label_is_not_benign(spark):
    df = spark.createDataFrame([("Benign",), ("DoS",), (None,)], "label string")
    assert [r[0] for r in df.select(is_malicious(F.col("label"))).collect()] == [0, 1, 1]


def test_integrate_keeps_null_and_undeclared_sources(spark):
    spec = WindowSpec(2, 2)
    pos = spark.createDataFrame([("b", 4), ("a", 2), (None, 2)], f"{spec.source} string, n_rows bigint")
    meta = spark.createDataFrame([("b", 0), ("b", 1), ("a", 0), (None, 0)], f"{spec.source} string, window_id bigint")
    for order, first in ((None, None), (["b"], "b")):
        out = integrate(meta, source_sizes(pos, spec, order), spec).collect()
        assert sorted(r["global_window_id"] for r in out) == [0, 1, 2, 3]
        assert next(r[spec.source] for r in out if r["global_window_id"] == 0) == first


def test_score_without_baseline_is_null(spark):
    spectra = spark.createDataFrame([(1, "x", [9.0, 1.0, 2.0]), (2, "y", [9.0, 1.0, 2.0])], "id int, channel string, amp array<double>")
    base = spark.createDataFrame([("x", 1, 0.0, 0.0), ("x", 2, 0.0, 0.0)], "channel string, bin int, mean double, var double")
    out = {r["id"]: r["freq_score"] for r in scores.freq_score(spectra, base, ["id"]).collect()}
    assert out[1] == pytest.approx(7.5) and out[2] is None


def test_attack_without_probabilities_stays(spark):
    rows = spark.createDataFrame([(1, ["A"], 1, 0.5), (1, ["B"], 0, None)], "is_malicious int, attacks array<string>, pred int, prob double")
    out = {r["attack"]: r["median_prob"] for r in attacks.attack_recall(rows).collect()}
    assert out == {"A": 0.5, "B": None}


def test_nan_scores_take_no_part(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 0), (float("nan"), 1)], "s double, label int")
    assert metrics.auc_roc(df, "s").first()["auc_roc"] == 0.0


def test_histogram_of_nulls_is_empty_bins(spark):
    out = profile.histogram(spark.createDataFrame([(None,)], "v double"), "v", 2).collect()
    assert [(r["bin"], r["n"]) for r in sorted(out, key=lambda r: r["bin"])] == [(0, 0), (1, 0)]


@pytest.mark.parametrize("fit", ["mle", "moments"])
def test_pot_threshold_without_a_tail(spark, fit):
    empty = thresholds.pot_threshold(spark.createDataFrame([], "s double"), "s", fit=fit).first()
    assert empty["threshold"] is None and empty["n"] == 0
    tied = spark.createDataFrame([(0.0,)] * 88 + [(5.0,)] * 12, "s double")
    row = thresholds.pot_threshold(tied, "s", q=0.8, fit=fit).first()
    assert (row["threshold"], row["xi"], row["exceedances"]) == (0.0, None, 12)


def test_small_class_has_a_null_memory(spark):
    rows = [(i, float(i % 7), "Benign") for i in range(150)] + [(200 + i, 1.0 * i, "DoS") for i in range(5)]
    df = spark.createDataFrame(rows, "ts int, v double, label string")
    out = {r["class"]: r["memory"] for r in memory.memory_by_class(df, ["v"], ["ts"], 20).collect()}
    assert set(out) == {"benign", "attack"} and out["attack"] is None and out["benign"] is not None


def test_every_tree_has_its_sample(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.rand(1).alias("v"))
    nodes = forest.iforest_fit(df, ["v"], "k", trees=5, sample=64)
    roots = {r["tree"]: r["size"] for r in nodes.where("node = 0").collect()}
    assert roots == dict.fromkeys(range(5), 64)
