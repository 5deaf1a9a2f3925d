import numpy as np
import pytest

from flowpane.operators import discrepancy as Y


def exact(a, b, gamma):
    a, b = a.reshape(len(a), -1), b.reshape(len(b), -1)
    k = lambda x, y: np.exp(-gamma * ((x[:, None] - y[None]) ** 2).sum(-1)).mean()
    return k(a, a) + k(b, b) - 2 * k(a, b)


def vectors(spark, a, b, extra=()):
    rows = [("a", v.tolist()) for v in a] + [("b", v.tolist()) for v in b] + list(extra)
    return spark.createDataFrame(rows, "side string, vector array<double>").repartition(5)


def test_frequencies_are_normal():
    w = Y.frequencies(2000, 3, 1)
    assert w.shape == (3, 2000) and abs(w.mean()) < 0.05 and abs(w.std() - 1) < 0.03
    assert abs(np.corrcoef(w)[0, 1]) < 0.06 and not np.allclose(w, Y.frequencies(2000, 3, 2))


def test_mmd_near_all_pairs(spark):
    """Within four of its own standard errors of the sum over all pairs, and exact for the frequencies drawn."""
    rng = np.random.default_rng(4)
    for shift in (0.0, 0.3, 1.0):
        a, b = rng.normal(size=(400, 3)), rng.normal(shift, 1.2, size=(300, 3))
        got = Y.mmd(vectors(spark, a, b, [("a", None), ("b", [1.0, None, 2.0]), ("a", [float("nan"), 0.0, 0.0]), ("c", [9.0, 9.0, 9.0])]), gamma=0.3).first()
        assert abs(got["mmd2"] - exact(a, b, 0.3)) < 4 * got["error"] and got["error"] < 0.1 * got["mmd2"] + 1e-3
        phase = lambda x: x @ Y.frequencies(Y.FREQUENCIES, 3, 0) * np.sqrt(0.6)
        want = ((np.cos(phase(a)).mean(0) - np.cos(phase(b)).mean(0)) ** 2 + (np.sin(phase(a)).mean(0) - np.sin(phase(b)).mean(0)) ** 2).mean()
        assert got["mmd2"] == pytest.approx(want, rel=1e-9) and got["mmd"] == pytest.approx(np.sqrt(want))


def test_width_from_all_pairs(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(70, 2)), rng.normal(2, 1, size=(40, 2))
    got = Y.mmd(vectors(spark, a, b)).first()
    assert got["gamma"] == pytest.approx(1 / (2 * ((a[:, None] - b[None]) ** 2).sum(-1).mean() + 1e-10))


def test_groups_and_missing_sides(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(50, 2)), rng.normal(1, 1, size=(50, 2))
    rows = [(g, s, v.tolist()) for g in ("x", None) for s, m in (("a", a), ("b", b)) for v in m] + [("alone", "a", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, side string, vector array<double>")
    one = Y.mmd(vectors(spark, a, b), gamma=0.5).first()["mmd2"]
    got = {r["g"]: r["mmd2"] for r in Y.mmd(df, ["g"], 0.5).collect()}
    assert got["x"] == pytest.approx(one) and got[None] == pytest.approx(one) and got["alone"] is None
    auto = {r["g"]: r["mmd2"] for r in Y.mmd(df, ["g"]).collect()}
    assert set(auto) == {"x", None} and auto["x"] == pytest.approx(auto[None])
    assert Y.mmd(df.filter("false"), ["g"], 0.5).count() == 0 and Y.mmd(df.filter("false")).count() == 0


def tall(spark, parts):
    rows = [(f, s, float(v)) for f, a, b in parts for s, m in (("a", a), ("b", b)) for v in m]
    return spark.createDataFrame(rows + [("f", "a", None), ("f", "b", float("inf"))], "feature string, side string, value double").repartition(6)


@pytest.mark.parametrize("gamma", [None, 0.5, 40.0])
def test_feature_mmd_equals_all_pairs(spark, gamma):
    rng = np.random.default_rng(7)
    heavy = rng.standard_cauchy(300)
    parts = [("f", rng.normal(size=500), rng.normal(0.2, 1.5, 400)), ("ties", rng.integers(0, 4, 300), rng.integers(1, 5, 200)),
             ("heavy", heavy, heavy * 1.1), ("same", heavy, heavy), ("far", rng.normal(size=50), rng.normal(1e5, 1, 50)), ("constant", np.ones(9), np.ones(7))]
    got = {r["feature"]: r for r in Y.mmd_per_feature(tall(spark, parts), gamma).collect()}
    assert set(got) == {p[0] for p in parts}
    for f, a, b in parts:
        a, b = np.asarray(a, float), np.asarray(b, float)
        g = gamma or 1 / (2 * ((a[:, None] - b[None]) ** 2).mean() + 1e-10)
        assert got[f]["gamma"] == pytest.approx(g, rel=1e-9)
        assert got[f]["mmd2"] == pytest.approx(exact(a, b, g), abs=1e-7 if gamma is None and f in ("far", "constant") else 1e-8)


def test_feature_without_a_side(spark):
    df = spark.createDataFrame([("f", "a", 1.0), ("g", "a", 1.0), ("g", "b", 1.0)], "feature string, side string, value double")
    assert [(r["feature"], r["mmd2"]) for r in Y.mmd_per_feature(df, 1.0).collect()] == [("g", 0.0)]


def test_cosines_by_look_up():
    rng = np.random.default_rng(8)
    phase = np.concatenate([rng.normal(size=5000) * 50, np.arange(-64, 64) * np.pi / 8, [0.0, -0.0, 1e5, -1e5]])
    for got, want in zip(Y.cos_sin(phase), (np.cos(phase), np.sin(phase)), strict=True):
        assert np.abs(got - want).max() < 1e-11
    large = np.array([1e300, -1e12, 3.0])
    assert (Y.cos_sin(large)[0] == np.cos(large)).all() and Y.cos_sin(np.zeros((0, 4)))[0].shape == (0, 4)
    with np.errstate(invalid="ignore"):
        assert np.isnan(Y.cos_sin(np.array([np.nan, np.inf, 1.0]))[1][:2]).all()


def test_the_draw_of_frequencies_is_kept():
    """It takes as long as some thousand rows, and every batch asks for it."""
    assert Y.frequencies(64, 2, 3) is Y.frequencies(64, 2, 3)


def test_vectors_that_count_several_times(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 2)), rng.normal(1, 1, size=(20, 2))
    often = rng.integers(1, 6, 50)
    rows = [("a" if i < 30 else "b", v.tolist(), int(n)) for i, (v, n) in enumerate(zip([*a, *b], often, strict=True))]
    merged = spark.createDataFrame(rows, "side string, vector array<double>, n long").repartition(4)
    each = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "side string, vector array<double>")
    for gamma in (None, 0.4):
        got, want = Y.mmd(merged, gamma=gamma, times="n").first(), Y.mmd(each, gamma=gamma).first()
        assert got["gamma"] == pytest.approx(want["gamma"]) and got["mmd2"] == pytest.approx(want["mmd2"], rel=1e-9)
        assert got["error"] == pytest.approx(want["error"])
