import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowpane.operators import splits as X
from flowpane.operators import window_features as G
from flowpane.operators import windows as W
from flowpane.operators.windows import WindowSpec

SPECS = [(100, 20), (20, 5), (7, 3), (10, 10), (4, 8), (4, 2)]


@pytest.fixture(scope="module")
def flows():
    rng = np.random.default_rng(3)
    parts = []
    for source, n in (("long", 2300), ("short", 120), ("tiny", 3)):
        parts.append(pd.DataFrame({
            "source": source, "ts": np.arange(n), "label": rng.choice(["Benign", "b", "a"], n, p=[0.96, 0.02, 0.02]),
            "v": 1e9 + rng.normal(size=n)}))
    return pd.concat(parts, ignore_index=True)


def brute(flows, size, step):
    out = []
    for source, g in flows.groupby("source"):
        g = g.sort_values("ts").reset_index(drop=True)
        for i in range(max(0, (len(g) - size) // step + 1)):
            w = g.iloc[i * step:i * step + size]
            bad = w.loc[w["label"] != "Benign", "label"]
            counts = bad.value_counts().to_dict()
            prim = min(counts, key=lambda k: (-counts[k], k)) if counts else None
            out.append((source, i, i * step, i * step + size, w["ts"].iloc[0], w["ts"].iloc[-1], int(len(bad) > 0),
                        len(bad), counts, prim, list(w["label"])))
    return {(r[0], r[1]): r[2:] for r in out}


@pytest.mark.parametrize("size,step", SPECS)
def test_meta_equals_brute_force(spark, flows, size, step):
    spec = WindowSpec(size, step)
    pos = W.position_flows(spark.createDataFrame(flows), spec, ["ts"])
    got = {(r.source, r.window_id): (r.start_idx, r.end_idx, r.start_time, r.end_time, r.is_malicious, r.n_malicious,
                                     r.attack_types, r.primary_attack, r.original_labels) for r in W.window_meta(pos, spec, original_labels=True).collect()}
    assert got == brute(flows, size, step)


@pytest.mark.parametrize("size,step", SPECS)
def test_long_form_has_whole_windows(spark, flows, size, step):
    spec = WindowSpec(size, step)
    pos = W.position_flows(spark.createDataFrame(flows), spec, ["ts"])
    long = W.sliding_windows(pos, spec)
    check = W.verify_windows(long, W.window_labels(pos, spec), spec, ["v"]).first()
    assert check["windows"] == check["meta_windows"] == len(brute(flows, size, step))
    assert check["wrong_length"] == check["unmatched"] == 0 and check["features"] == 1
    most = long.groupBy("source", "pos").count().agg(F.max("count")).first()[0]
    assert most <= -(-size // step)


@pytest.mark.parametrize("size,step", [(100, 20), (7, 3), (20, 5)])
def test_pane_statistics_are_stable(spark, flows, size, step):
    """Deviations of order 1 around 1e9 survive."""
    spec = WindowSpec(size, step)
    pos = W.position_flows(spark.createDataFrame(flows), spec, ["ts"])
    got = G.window_stats(pos, spec, ["v"], G.STATS).toPandas()
    by = {s: g.sort_values("ts")["v"].to_numpy() for s, g in flows.groupby("source")}
    for r in got.itertuples():
        x = by[r.source][r.window_id * step:r.window_id * step + size]
        assert r.v_std == pytest.approx(x.std(), rel=1e-6)
        assert r.v_mean == pytest.approx(x.mean(), rel=1e-14) and r.v_median == pytest.approx(np.median(x), rel=1e-14)
        assert (r.v_min, r.v_max, r.v_last) == (x.min(), x.max(), x[-1])


def test_integration_and_split(spark, flows):
    spec = WindowSpec(20, 5)
    pos = W.position_flows(spark.createDataFrame(flows), spec, ["ts"])
    sizes = W.source_sizes(pos, spec, ["short", "long"])
    m = W.integrate(W.window_labels(pos, spec), sizes, spec)
    ids = [r[0] for r in m.select("global_window_id").orderBy("global_window_id").collect()]
    total = X.total_windows(sizes)
    assert ids == list(range(total))
    first = W.source_index(m).where("source = 'short'").first()
    assert (first["start"], first["end"]) == (0, (120 - 20) // 5 + 1)
    s = X.split_chrono(m, total).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s}["train"] == int(total * 0.6)


def test_series_follow_row_order(spark, flows):
    spec = WindowSpec(20, 5)
    pos = W.position_flows(spark.createDataFrame(flows), spec, ["ts"])
    got = {(r.source, r.window_id): r.x for r in W.window_series(pos, spec, ["v"]).collect()}
    by = {s: g.sort_values("ts")["v"].to_numpy() for s, g in flows.groupby("source")}
    assert all(np.array_equal(x, by[s][i * 5:i * 5 + 20]) for (s, i), x in got.items())


def test_balanced_split_falls_back(spark):
    meta = spark.createDataFrame([("only", i, i, int(i % 4 == 0)) for i in range(40)],
                                 "source string, window_id bigint, global_window_id bigint, is_malicious int")
    p = X.balanced_points(meta).first()
    assert (p["train_end"], p["val_end"], p["fallback"]) == (26, 32, True)


@pytest.mark.parametrize("size,step", SPECS)
def test_attack_counts_add_up_with_missing_labels(spark, flows, size, step):
    """A missing label is malicious and an attack of unknown kind: every window's counts sum to its malicious rows."""
    spec = WindowSpec(size, step)
    holes = flows.assign(label=[None if i % 11 == 3 else x for i, x in enumerate(flows["label"])])
    meta = W.window_meta(W.position_flows(spark.createDataFrame(holes), spec, ["ts"]), spec)
    assert "original_labels" not in meta.columns
    want = brute(holes.assign(label=holes["label"].fillna("Unknown")), size, step)
    got = {(r.source, r.window_id): (r.n_malicious, r.attack_types, r.primary_attack) for r in meta.collect()}
    assert got == {k: (v[5], v[6], v[7]) for k, v in want.items()}
    assert all(n == sum(c.values()) for n, c, _ in got.values())


def test_attack_counts_gather_no_lists(spark, flows):
    spec = WindowSpec(20, 5)
    pos = W.position_flows(spark.createDataFrame(flows), spec, ["ts"])
    plan = W.attack_counts(pos, spec)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
