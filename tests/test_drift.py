import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowpane.operators import drift as I
from flowpane.operators import vectors as V


def tall(spark, a, b, feature="f"):
    pdf = pd.DataFrame({"feature": feature, "side": ["a"] * len(a) + ["b"] * len(b), "value": np.concatenate([a, b]).astype(float)})
    return spark.createDataFrame(pdf)


def ks_wass(a, b):
    v = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), v, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), v, side="right") / len(b)
    return np.abs(fa - fb).max(), float((np.abs(fa - fb)[:-1] * np.diff(v)).sum())


@pytest.mark.parametrize("make", [lambda r: (r.normal(size=700), r.normal(0.3, 2, 500)),
                                  lambda r: (np.where(r.random(900) < 0.5, 0, r.integers(0, 9, 900)), r.integers(0, 9, 300))])
def test_distances(spark, make):
    a, b = make(np.random.default_rng(2))
    got = I.distribution_distances(tall(spark, a, b)).first()
    back = I.distribution_distances(tall(spark, b, a)).first()
    assert (got["ks"], got["wasserstein"]) == pytest.approx(ks_wass(a, b))
    assert (back["ks"], back["wasserstein"]) == pytest.approx((got["ks"], got["wasserstein"]))
    assert (got["n_a"], got["n_b"]) == (len(a), len(b))


def test_wasserstein_of_a_shift(spark):
    a = np.random.default_rng(3).normal(size=400)
    assert I.distribution_distances(tall(spark, a, a + 2.5)).first()["wasserstein"] == pytest.approx(2.5)


def test_pvalue(spark):
    df = spark.createDataFrame([(0.0, 100, 100), (0.1923, 100, 100), (0.9, 100, 100)], "ks double, n_a bigint, n_b bigint")
    p = [r["p_value"] for r in I.with_significance(df).orderBy("ks").collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(0.0495, abs=2e-3) and p[2] < 1e-9


def test_block_cells_see_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(V, "with_block", lambda df, key, rows, block_rows=0: (
        df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(5)).cast("int")), 5))
    x = np.random.default_rng(5).normal(size=(83, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    off = g[np.triu_indices(83, 1)]
    s = V.cosine_summary(df, "id", "v").first()
    assert (s["mean"], s["max"], s["min"]) == pytest.approx((off.mean(), off.max(), off.min()))
    m = V.cosine_matrix(df, "id", "v").toPandas()
    assert len(m) == 83 * 83 and np.allclose(m["cosine"], g[m["a"], m["b"]])


def test_cosine_summary_sends_a_vector_to_few_cells(spark, monkeypatch):
    """Ten times the rows must not send every vector to ten times the cells; strips and blocks change no result."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 8)
    monkeypatch.setattr(V, "FEW_BLOCKS", 3)
    monkeypatch.setattr(V, "STRIP_ROWS", 7)
    x = np.random.default_rng(2).normal(size=(200, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>")
    assert V._unit_cells(df, "id", "v", only_sums=True).count() <= 3 * 200
    assert V._unit_cells(df, "id", "v").count() == 25 * 200
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    off = (u @ u.T)[np.triu_indices(200, 1)]
    s = V.cosine_summary(df, "id", "v").first()
    assert (s["mean"], s["max"], s["min"]) == pytest.approx((off.mean(), off.max(), off.min()))
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 50)
    assert V.summary_block_rows(200, 5) == 10 and V.summary_block_rows(20, 5) == 8
    assert V.cosine_summary(df, "id", "v").first()["max"] == pytest.approx(off.max())


def test_band_weight_shape(spark):
    w = [r[0] for r in spark.range(51).select(I.band_weight(F.col("id"), 51)).collect()]
    assert w[0] == 0 and w[3] == 0.2 and w[12] == 1.0 and w[40] == 0.6 and w[5] <= w[7] <= w[9]


def test_precision_weights_of_a_flat_curve(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(51)], "bin int, s double")
    w = I.precision_weights(df, "s").orderBy("bin").collect()
    assert all(r["smooth"] == pytest.approx(0.5) for r in w[:20]) and w[50]["smooth"] == pytest.approx(0.68)


def test_drift_verdicts(spark):
    df = spark.createDataFrame([("A", "x", 0.5), ("B", "x", 0.48), ("A", "y", 0.5), ("B", "y", 0.1), ("A", "z", 0.1), ("B", "z", 0.05)],
                               "pair string, feature string, ks double")
    assert {r["feature"]: r["source"] for r in I.drift_sources(df).collect()} == {"x": "Covariate", "y": "Anomaly", "z": "Mixed"}


def test_rows_of_overlapping_windows_are_counted_vectors(spark):
    """A flow row stands in up to five windows here; what goes on is one row, with how often it counts."""
    from collections import Counter

    from flowpane.plans.window_job import build_window_set
    from flowpane.operators.windows import WindowSpec

    rows = [("s", i, "x" if 25 <= i < 27 else "Benign", float(i % 40), None if i == 3 else float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, ts int, label string, u double, v double")
    w = build_window_set(df, WindowSpec(20, 4), ["ts"], ["u", "v"])
    got = I.counted_vectors(w.vectors(["u", "v"]), ["split", "is_malicious"]).collect()
    want = Counter()
    for first in range(0, 41, 4):
        own = rows[first:first + 20]
        split = "train" if first // 4 < 6 else "val" if first // 4 < 8 else "test"
        for r in own:
            want[split, int(any(x[2] == "x" for x in own)), (r[3], r[4])] += 1
    assert {(r["split"], r["is_malicious"], tuple(r["vector"])): r["n"] for r in got} == want and len(got) == len(want)
