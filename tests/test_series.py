import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowpane.functions import signal as S
from flowpane.operators import memory as M
from flowpane.operators import series as D
from flowpane.operators import window_features as G

W, N = 100, 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    t = np.arange(W)
    return np.array([np.sin(2 * np.pi * t * (i + 2) / W) * 3 + 0.05 * t + rng.normal(size=W) for i in range(N)])


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame([("s", i, "c", [float(v) for v in x]) for i, x in enumerate(data)],
                                 "source string, window_id bigint, channel string, x array<double>")


def grab(df, *cols):
    rows = df.orderBy("window_id").collect()
    out = [np.array([r[c] for r in rows], dtype=float) for c in cols]
    return out if len(out) > 1 else out[0]


def test_spectrum(df, data):
    amp = grab(G.rfft_amplitude(df, log1p=False), "amp")
    assert np.allclose(amp, np.abs(np.fft.rfft(data, axis=1)))
    weight = np.where((np.arange(51) == 0) | (np.arange(51) == 50), 1, 2)
    assert np.allclose((amp ** 2 * weight).sum(1) / W, (data ** 2).sum(1))  # Parseval
    assert np.allclose(grab(G.rfft_amplitude(df), "amp"), np.log1p(amp))


def test_phase_is_null_without_amplitude(spark):
    df = spark.createDataFrame([("s", 0, "c", [1.0] * 8)], "source string, window_id bigint, channel string, x array<double>")
    assert G.rfft_phase(df).first()["phase"] == [0.0, None, None, None, None]


def test_moving_averages(df, data):
    pad = np.concatenate([np.repeat(data[:, :1], 12, 1), data, np.repeat(data[:, -1:], 12, 1)], axis=1)
    want = np.stack([np.convolve(p, np.ones(25) / 25, "valid") for p in pad])
    assert np.allclose(grab(D.sma(df), "trend"), want)
    zero = np.concatenate([np.zeros((N, 24)), data], axis=1)
    assert np.allclose(grab(D.causal_sma(df), "trend"), np.stack([np.convolve(p, np.ones(25) / 25, "valid") for p in zero]))
    with pytest.raises(ValueError):
        D.sma(df, 24)


def test_exponential_averages(df, data):
    def ema(x):
        y = x.copy()
        for t in range(1, W):
            y[:, t] = 0.3 * x[:, t] + 0.7 * y[:, t - 1]
        return y
    assert np.allclose(grab(D.ema(df), "trend"), ema(data))
    assert np.allclose(grab(D.dema(df), "trend"), 2 * ema(data) - ema(ema(data)))


@pytest.mark.parametrize("trend", ["ema", "sma", "dema"])
def test_decomposition_adds_up(df, data, trend):
    t, s, r = grab(D.decompose(df, trend), "trend", "seasonal", "residual")
    assert np.allclose(t + s + r, data)


def test_energy_filter_keeps_everything_at_one(df, data):
    assert np.allclose(grab(D.dft_energy_filter(df, tau=1.0), "seasonal"), data)


def test_topk_finds_the_wave(spark):
    x = np.cos(2 * np.pi * 7 * np.arange(W) / W)
    df = spark.createDataFrame([("s", 0, "c", (x + 4).tolist())], "source string, window_id bigint, channel string, x array<double>")
    s, t = grab(D.dft_topk(df, top_k=1), "seasonal", "trend")
    assert np.allclose(s[0], x) and np.allclose(t[0], 4)


def test_hodrick_prescott_solves_the_system(df, data):
    trend = grab(D.hp_filter(df, 100.0), "trend")
    d = np.diff(np.eye(W), n=2, axis=0)
    assert np.allclose((np.eye(W) + 100.0 * d.T @ d) @ trend.T, data.T)


def test_instance_norm_round_trip(df, data):
    n = G.instance_norm(df)
    z = grab(n, "x")
    assert np.allclose(z.mean(1), 0) and np.allclose(z.std(1), 1, atol=1e-4)
    assert np.allclose(grab(G.instance_denorm(n), "x"), data)


def test_periods(df, data):
    z = (data - data.mean(1, keepdims=True)) / np.sqrt(data.var(1, keepdims=True) + 1e-5)
    n = G.instance_norm(df).drop("centre", "scale")
    p = D.dominant_periods(n).toPandas().sort_values(["window_id", "rank"])
    agg = grab(D.delay_aggregate(n), "aggregated")
    for i in range(N):
        corr = np.array([np.dot(z[i], np.roll(z[i], d)) for d in range(W)])
        rows = p[p["window_id"] == i]
        assert len(rows) == int(np.log(W)) and rows["weight"].sum() == pytest.approx(1.0)
        assert np.allclose(np.sort(corr[rows["delay"]])[::-1], np.sort(corr)[::-1][:len(rows)])
        want = sum(w * np.roll(z[i], -d) for w, d in zip(rows["weight"], rows["delay"]))
        assert np.allclose(agg[i], want)


def test_rolling_masks_cover_each_bin_once(df):
    s = G.by_bin(G.rfft_amplitude(df)).withColumn("segment", G.rolling_segment(F.col("bin"), 51, 7))
    seg = s.where("window_id = 0").select("bin", "segment").toPandas()
    assert seg[seg["bin"] == 0]["segment"].isna().all()
    rest = seg[seg["bin"] > 0]
    assert rest["segment"].notna().all() and rest["segment"].nunique() == 7 and rest.groupby("segment").size().max() == 8


def test_random_masks_keep_dc(df):
    m = G.mask_bins_random(G.rfft_amplitude(df), ["source", "window_id"], 51, 3).collect()
    for r in m:
        assert 0 not in r["masked_bins"] and 10 <= len(r["masked_bins"]) <= 25
        assert all((a == 0.0) == (i in r["masked_bins"]) or a == 0.0 for i, a in enumerate(r["amp_masked"]))


def test_autocorrelation_across_blocks(spark):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=10_000)) + 50  # more than two blocks
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    got = M.acf(df, ["x"], ["i"], 60).orderBy("lag").toPandas()
    z = (x - x.mean()) / (x.std() + 1e-8)
    want = np.array([np.dot(z[:len(z) - k], z[k:]) for k in range(61)])
    assert np.allclose(got["r"], want / want[0])


def test_memory_length_rules(spark):
    crit = S.inverse_normal(0.975) / np.sqrt(400)
    r = np.zeros(41)
    r[:6] = 3 * crit      # significant up to lag 5
    r[8:10] = 3 * crit    # then again at 8 and 9
    acf = spark.createDataFrame([("f", i, 400, float(v)) for i, v in enumerate(r)], "feature string, lag int, n bigint, r double")
    assert M.memory_length(acf).first()["memory"] == 5
    assert M.memory_length(acf, variant="tolerant", max_lag=40).first()["memory"] == 9
    none = acf.withColumn("r", F.lit(0.0))
    assert M.memory_length(none).first()["memory"] == 0
    assert M.memory_length(none, variant="tolerant", max_lag=40).first()["memory"] == 0


def test_trend_by_five_diagonals():
    """The elimination solves the dense system, for every length, and costs the same per row and value."""
    from flowpane.functions.signal import _smooth_trend
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 4, 5, 100, 257):
        m = rng.normal(size=(6, n)).cumsum(axis=1)
        d = np.diff(np.eye(n), n=2, axis=0)
        for lamb in (0.5, 6400.0):
            assert np.allclose(_smooth_trend(m, lamb), np.linalg.solve(np.eye(n) + lamb * (d.T @ d), m.T).T)
