import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowpane.operators import attacks as T
from flowpane.operators import forest
from flowpane.operators import importance as M
from flowpane.operators import metrics as E
from flowpane.operators import profile as P
from flowpane.operators import sampling as S
from flowpane.operators import scores as J
from flowpane.operators import thresholds as K


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(6)
    y = (rng.random(1500) < 0.2).astype(int)
    s = np.round(rng.normal(size=1500) + y, 2)
    s[rng.random(1500) < 0.35] = 0.25  # a third of the rows share one score
    return pd.DataFrame({"id": np.arange(1500), "label": y, "score": s, "split": np.where(np.arange(1500) % 2, "val", "test")})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def f1(y, p):
    tp = int((y & p).sum())
    return 0.0 if tp == 0 else 2 * tp / (y.sum() + p.sum())


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_best_f1_equals_brute_force(df, pdf):
    for steps in (7, 100, 1000):
        got = K.best_f1(df, "score", n_steps=steps).first()
        grid = np.linspace(pdf["score"].min(), pdf["score"].max(), steps)
        values = [f1(pdf["label"].to_numpy(), (pdf["score"] > t).to_numpy().astype(int)) for t in grid]
        i = int(np.argmax(values))
        assert got["f1_star"] == pytest.approx(values[i]) and got["threshold"] == pytest.approx(grid[i])


def test_best_f1_of_a_constant_score(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "score double, label int")
    assert tuple(K.best_f1(df, "score").first()) == (0.0, 0.0, 0.0, 0.0)


def test_best_f1_percentile(df, pdf):
    got = K.best_f1_percentile(df, "score").first()
    grid = np.percentile(pdf["score"], np.linspace(50, 99.9, 100))
    values = [f1(pdf["label"].to_numpy(), (pdf["score"] > t).to_numpy().astype(int)) for t in grid]
    assert got["f1_star"] == pytest.approx(max(values)) and got["threshold"] == pytest.approx(grid[int(np.argmax(values))])


def test_ranking_metrics(df, pdf):
    got = E.ranking_metrics(df, "score").first()
    flipped = E.auc_roc(df.withColumn("score", -F.col("score")), "score").first()["auc_roc"]
    assert got["auc_roc"] == pytest.approx(auc(pdf["label"].to_numpy(), pdf["score"].to_numpy()))
    assert flipped == pytest.approx(1 - got["auc_roc"])
    cube = E.auc_roc(df.withColumn("score", F.pow("score", F.lit(3))), "score").first()["auc_roc"]
    assert cube == pytest.approx(got["auc_roc"])
    y, s = pdf["label"].to_numpy(), pdf["score"].to_numpy()
    prev_r, prev_p, ap, tr = 0.0, 1.0, 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        r, p = (y & hit).sum() / y.sum(), (y & hit).sum() / hit.sum()
        ap, tr = ap + (r - prev_r) * p, tr + (r - prev_r) * (p + prev_p) / 2
        prev_r, prev_p = r, p
    assert got["average_precision"] == pytest.approx(ap) and got["pr_auc"] == pytest.approx(tr)
    assert E.auc_roc(df.where("label = 0"), "score").first()["auc_roc"] == 0.0


@pytest.mark.parametrize("small", [0, 100_000])
def test_rank_fusion(df, pdf, small, monkeypatch):
    from flowpane.operators import ordered
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", small)
    got = J.rank_fuse(df.withColumn("other", -F.col("id")), ["score", "other"]).toPandas().set_index("id")["fused_score"]
    g = pdf.assign(other=-pdf["id"]).groupby("split")
    norm = lambda c: (g[c].rank() - 1) / (g[c].transform("size") - 1)
    assert np.allclose(got.sort_index(), norm("score") + norm("other"))


@pytest.mark.parametrize("xi,sigma", [(0.3, 2.0), (-0.25, 1.0), (0.0, 1.5)])
def test_pareto_fit(spark, xi, sigma):
    u = (np.arange(20000) + 0.5) / 20000
    y = -sigma * np.log(1 - u) if xi == 0 else sigma / xi * ((1 - u) ** -xi - 1)
    got_xi, got_sigma = K._fit_likelihood(spark.createDataFrame(pd.DataFrame({"y": y})))
    assert got_xi == pytest.approx(xi, abs=0.02) and got_sigma == pytest.approx(sigma, rel=0.03)


def test_pot_falls_back_on_few_exceedances(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "score double")
    r = K.pot_threshold(df, "score", 0.95).first()
    assert r["exceedances"] == 5 and r["threshold"] == pytest.approx(np.percentile(np.arange(100), 95))


def test_kde(df, pdf):
    got = E.score_kde(df, "score", ["label"], 50, -2, 3).toPandas()
    for y, g in pdf.groupby("label"):
        s = g["score"].to_numpy()
        bw = s.std(ddof=1) * len(s) ** -0.2
        x = np.linspace(-2, 3, 50)
        want = np.exp(-0.5 * ((x[:, None] - s) / bw) ** 2).mean(1) / (bw * np.sqrt(2 * np.pi))
        assert np.allclose(got[got["label"] == y].sort_values("x")["density"], want)


def test_histogram_totals(df, pdf):
    h = P.histogram(df, "score", 20).toPandas().sort_values("bin")
    assert np.array_equal(h["n"], np.histogram(pdf["score"], 20)[0])


def test_samples(df, pdf):
    s = S.stratified_sample(df, "label", "id", 300, 9)
    n1 = int(300 * pdf["label"].mean())
    assert {r["label"]: r["count"] for r in s.groupBy("label").count().collect()} == {1: n1, 0: 300 - n1}
    assert sorted(r["id"] for r in s.collect()) == sorted(r["id"] for r in S.stratified_sample(df.repartition(3), "label", "id", 300, 9).collect())
    assert S.stratified_sample(df, "label", "id", 5000, 9).count() == 1500


def test_attack_sets(spark):
    meta = spark.createDataFrame([
        (0, 0, {}, None), (1, 1, {"Bot": 2, "DDoS": 1}, "Bot"), (2, 1, {"Bot": 3}, "Bot"), (3, 1, None, "Infilteration"), (4, 1, {"Bot": 0}, None)],
        "global_window_id bigint, is_malicious int, attack_types map<string,bigint>, primary_attack string")
    m = T.with_attacks(meta)
    assert [r["attacks"] for r in m.orderBy("global_window_id").collect()] == [[], ["Bot", "DDoS"], ["Bot"], ["Infiltration"], []]
    stats = {r["statistic"]: r["n"] for r in T.attack_set_stats(m).collect()}
    assert stats == {"benign_windows": 1, "malicious_windows": 4, "mixed_windows": 1, "unknown_windows": 1,
                     "attack_set_size_0": 1, "attack_set_size_1": 2, "attack_set_size_2": 1}
    pred = spark.createDataFrame([(i, int(i in (1, 2)), i / 10) for i in range(5)], "global_window_id bigint, pred int, prob double")
    a = T.align(pred, m)
    rec = {r["attack"]: (r["count"], r["tp"], r["place"]) for r in T.attack_recall(a).collect()}
    assert rec == {"Bot": (2, 2, 1), "DDoS": (1, 1, 2), "Infiltration": (1, 0, 3), "Unknown": (1, 0, 4)}
    assert {r["attack"] for r in T.attack_recall(a, pure=True).collect()} == {"Bot", "Infiltration"}
    assert T.benign_accuracy(a).first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        T.align(pred.where("global_window_id > 0"), m)


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(400, 2)), rng.normal(12, 0.1, size=(5, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    for trees, sample in ((40, 64), (4, 64)):  # each tree draws its own rows; rows are dealt out
        nodes = forest.iforest_fit(df.where("id < 400"), ["a", "b"], "id", trees, sample, 1)
        got = forest.iforest_score(df, ["a", "b"], nodes).toPandas().set_index("id")["score"]
        assert got.loc[400:].min() > got.loc[:399].quantile(0.95)
        assert nodes.groupBy("tree").count().count() == trees
        assert nodes.where("node = 0").agg(F.min("size"), F.max("size")).first()[:] == (sample, sample)


def test_importance_tables(spark):
    imp = spark.createDataFrame([("c", 0, 0.2), ("a", 1, 0.5), ("b", 2, 0.2), ("z", 3, 0.00005), ("d", 4, 0.09995)],
                                "feature string, ordinal int, importance double")
    assert [r["feature"] for r in M.importance_table(imp).orderBy("rank").collect()] == ["a", "b", "c", "d", "z"]
    cut = {r["threshold"]: r["features"] for r in M.importance_cutoffs(imp).collect()}
    assert cut[0.5] == 1 and cut[0.8] == 3 and cut[0.99] == 4
    assert [r["feature"] for r in M.select_top_k(imp, 3).collect()] == ["c", "a", "b"]
    low = {r["threshold"]: (r["features"], r["first"]) for r in M.low_importance(imp).collect()}
    assert low[0.0001] == (1, ["z"]) and low[0.01] == (1, ["z"])
    assert {r["feature"] for r in M.select_median(imp).collect()} == {"a", "b", "c"}


def test_confusion_from_rates_rounds_half_to_even(spark):
    df = spark.createDataFrame([(5, 10, 1.0, 0.5)], "total_positive bigint, total_negative bigint, precision double, recall double")
    r = E.confusion_from_pr(df).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (2, 3, 0, 10)


def test_episodes(spark):
    rows = [(0, 1, "x"), (1, 1, "x"), (2, 1, "y"), (3, 0, None), (4, 1, "y"), (5, 1, "y"), (6, 1, "y")]
    meta = spark.createDataFrame(rows, "global_window_id bigint, is_malicious int, primary_attack string")
    ep = P.attack_episodes(meta, 100).orderBy("episode").collect()
    assert [(r["attack"], r["first_window"], r["last_window"], r["duration"]) for r in ep] == [("x", 0, 1, 200), ("y", 2, 2, 100), ("y", 4, 6, 300)]
    st = {r["attack"]: (r["episodes"], r["median"]) for r in P.episode_stats(P.attack_episodes(meta, 100)).collect()}
    assert st == {"x": (1, 200.0), "y": (2, 200.0)}
