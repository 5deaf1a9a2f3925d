import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowpane.operators import long_series as L


def series(n=700, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["b", "c"], n))
    return pd.DataFrame({"key": key, "t": rng.integers(0, 50, n), "id": rng.permutation(n), "v": rng.normal(size=n).cumsum()})


def loop(x, alpha):
    y = [x[0]]
    for v in x[1:]:
        y.append(alpha * v + (1 - alpha) * y[-1])
    return np.array(y)


def per_key(df, fn):
    parts = [g.assign(want=fn(g["v"].to_numpy())) for _, g in df.sort_values(["key", "t", "id"]).groupby("key")]
    return pd.concat(parts)[["id", "want"]]


@pytest.mark.parametrize("block", [5, 64, 8192])
@pytest.mark.parametrize("alpha", [0.3, 0.004])
def test_exponential_mean_over_many_blocks(spark, monkeypatch, block, alpha):
    """Blocks of 5 rows are scanned in several levels; a small alpha carries far over their borders."""
    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    df = series()
    sdf = spark.createDataFrame(df).repartition(5)
    got = L.exponential_mean(sdf, ["key"], ["t", "id"], "v", alpha).toPandas().merge(per_key(df, lambda x: loop(x, alpha)), on="id")
    assert len(got) == len(df) and np.allclose(got["trend"], got["want"], rtol=1e-9, atol=1e-9)
    if block == 64:
        twice = L.exponential_mean(sdf, ["key"], ["t", "id"], "v", alpha, double=True).toPandas()
        want = per_key(df, lambda x: 2 * loop(x, alpha) - loop(loop(x, alpha), alpha))
        got = twice.merge(want, on="id")
        assert np.allclose(got["trend"], got["want"], rtol=1e-9, atol=1e-9)


def test_missing_values_are_skipped(spark):
    rows = [("a", 0, None), ("a", 1, 2.0), ("a", 2, float("nan")), ("a", 3, 4.0), ("a", 4, float("inf")), ("b", 0, None), (None, 0, 1.0), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "key string, t int, v double")
    got = {(r["key"], r["t"]): r["trend"] for r in L.exponential_mean(df, ["key"], ["t"], "v", 0.5).collect()}
    assert got == {("a", 0): None, ("a", 1): 2.0, ("a", 2): None, ("a", 3): 3.0, ("a", 4): None, ("b", 0): None, (None, 0): 1.0, (None, 1): 2.0}
    assert L.exponential_mean(df.filter("false"), ["key"], ["t"], "v").count() == 0


@pytest.mark.parametrize("before,after", [(9, 0), (3, 4), (0, 6), (70, 20)])
def test_frames_cross_block_borders(spark, monkeypatch, before, after):
    monkeypatch.setattr(L, "BLOCK_ROWS", 16)
    df = series(400)
    sdf = spark.createDataFrame(df).repartition(4)
    got = L.framed(sdf, ["key"], ["t", "id"], {"s": lambda: F.sum("v"), "m": lambda: F.max("v")}, before, after).toPandas()
    span = lambda x, fn: [fn(x[max(0, i - before) : i + after + 1]) for i in range(len(x))]
    got = got.merge(per_key(df, lambda x: span(x, np.sum)), on="id").merge(per_key(df, lambda x: span(x, np.max)), on="id")
    assert len(got) == len(df) and np.allclose(got["s"], got["want_x"]) and np.allclose(got["m"], got["want_y"])


def test_moving_means(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 32)
    df = series(300)
    sdf = spark.createDataFrame(df)
    causal = L.moving_mean(sdf, ["key"], ["t", "id"], "v", 5).toPandas()
    centred = L.moving_mean(sdf, ["key"], ["t", "id"], "v", 5, centred=True).toPandas()
    a = causal.merge(per_key(df, lambda x: pd.Series(x).rolling(5, min_periods=1).mean().to_numpy()), on="id")
    b = centred.merge(per_key(df, lambda x: pd.Series(x).rolling(5, min_periods=1, center=True).mean().to_numpy()), on="id")
    assert np.allclose(a["trend"], a["want"]) and np.allclose(b["trend"], b["want"])
