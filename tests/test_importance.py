import numpy as np
import pandas as pd
import pytest

from flowpane.operators import importance as M


@pytest.fixture(scope="module")
def imp():
    rng = np.random.default_rng(2)
    v = np.round(rng.pareto(1.5, 500), 3)
    v[100:140] = 0.25  # ties
    return pd.DataFrame({"feature": [f"f{i:03d}" for i in range(500)], "ordinal": np.arange(500), "importance": v / v.sum()})


def test_ranked_scan(spark, imp):
    t = M.importance_table(spark.createDataFrame(imp).repartition(7)).toPandas().sort_values("rank")
    want = imp.sort_values(["importance", "feature"], ascending=[False, True])
    assert t["feature"].tolist() == want["feature"].tolist() and t["rank"].tolist() == list(range(1, 501))
    assert np.allclose(t["cumulative"], want["importance"].cumsum())


def test_cutoffs_census_and_stats(spark, imp):
    df = spark.createDataFrame(imp)
    order = imp.sort_values(["importance", "feature"], ascending=[False, True])
    cum = order["importance"].cumsum().to_numpy()
    got = {r["threshold"]: r["features"] for r in M.importance_cutoffs(df, [0.5, 0.9, 2.0]).collect()}
    assert got == {0.5: int((cum < 0.5).sum()) + 1, 0.9: int((cum < 0.9).sum()) + 1, 2.0: 1}
    for r in M.low_importance(df, [1e-4, 1e-3, 0.0], 4).collect():
        below = order[order["importance"] < r["threshold"]]
        assert r["features"] == len(below) and r["first"] == below["feature"].tolist()[:4] and r["pct"] == pytest.approx(len(below) / 5)
    s = M.importance_stats(df).first()
    assert s["median"] == pytest.approx(imp["importance"].median()) and s["q90"] == pytest.approx(imp["importance"].quantile(0.9))
    assert {r["feature"] for r in M.select_median(df).collect()} == set(imp[imp["importance"] >= imp["importance"].median()]["feature"])
    assert [r["feature"] for r in M.select_top_k(df, 9).collect()] == order.head(9).sort_values("ordinal")["feature"].tolist()


def test_no_task_takes_the_whole_table(spark, imp):
    df = spark.createDataFrame(imp)
    for out in (M.importance_table(df), M.importance_cutoffs(df).select("threshold")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan
