"""Vectorised transforms of one window at a time, given as ``ARRAY<DOUBLE>``.

Array lambdas run interpreted, element by element; measured here they cost several microseconds per element, a
transform of a whole Arrow batch as one NumPy matrix a small fraction of one. So what works along a window is written
as a matrix operation on a batch of windows. Nothing here looks across rows: partitioning stays with Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ARRAY = "array<double>"


def _same_length(s: pd.Series):
    """(row positions, matrix) for each array length of the batch; missing and empty arrays are left out."""
    lengths = s.map(lambda a: 0 if a is None else len(a)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([np.asarray(a, dtype=np.float64) for a in s.iloc[at]])


def _array_fn(fn: Callable[[np.ndarray], np.ndarray]):
    """A column function from a matrix function; a 1-D result gives one number per window."""
    def call(s: pd.Series) -> pd.Series:
        out = np.empty(len(s), dtype=object)
        for at, m in _same_length(s):
            for i, row in zip(at, fn(m)):
                out[i] = row
        return pd.Series(out)
    return F.pandas_udf(call, _ARRAY)


def _struct_fn(fn: Callable[[np.ndarray], dict[str, np.ndarray]], fields: dict[str, str]):
    """A column function whose result is a struct of the named parts."""
    def call(s: pd.Series) -> pd.DataFrame:
        out = {k: np.empty(len(s), dtype=object) for k in fields}
        for at, m in _same_length(s):
            for k, part in fn(m).items():
                for i, row in zip(at, part):
                    out[k][i] = row
        return pd.DataFrame(out)
    return F.pandas_udf(call, ", ".join(f"{k} {t}" for k, t in fields.items()))


# ---- matrix operations: one row per window -------------------------------------------------------------------------

def _moving_mean(padded: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(padded, k, axis=1).mean(axis=-1)


def _centred(m: np.ndarray, k: int) -> np.ndarray:
    return _moving_mean(np.pad(m, ((0, 0), ((k - 1) // 2, (k - 1) // 2)), mode="edge"), k)


def _ema(m: np.ndarray, alpha: float) -> np.ndarray:
    y = np.array(m)
    for t in range(1, m.shape[1]):
        y[:, t] = alpha * m[:, t] + (1 - alpha) * y[:, t - 1]
    return y


def _dema(m: np.ndarray, alpha: float) -> np.ndarray:
    once = _ema(m, alpha)
    return 2 * once - _ema(once, alpha)


def _keep_bins(m: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(m, axis=1) * keep, n=m.shape[1], axis=1)


def _energy_filter(m: np.ndarray, top_k: int, low: float, tau: float) -> np.ndarray:
    amp2 = np.abs(np.fft.rfft(m, axis=1)) ** 2
    amp2[:, 0] = 0.0
    share = np.cumsum(amp2, axis=1) / (amp2.sum(axis=1, keepdims=True) + 1e-8)
    bins = amp2.shape[1]
    always = min(max(top_k, int(bins * low)), bins)
    return _keep_bins(m, (share <= tau) | (np.arange(bins) < always))


def _odd(k: int) -> int:
    if k % 2 == 0:
        raise ValueError("the width of a centred mean must be odd")
    return k


# ---- smoothing and decomposition -----------------------------------------------------------------------------------

def centred_mean(x: Column, k: int) -> Column:
    """Moving average of odd width ``k``; the edges see the first and last value repeated."""
    width = _odd(k)
    return _array_fn(lambda m: _centred(m, width))(x)


def causal_mean(x: Column, k: int) -> Column:
    """Mean over the last ``k`` values, zeros before the first."""
    return _array_fn(lambda m: _moving_mean(np.pad(m, ((0, 0), (k - 1, 0))), k))(x)


def ema(x: Column, alpha: float) -> Column:
    """y0 = x0, y = alpha * x + (1 - alpha) * y."""
    return _array_fn(lambda m: _ema(m, alpha))(x)


def dema(x: Column, alpha: float) -> Column:
    """2 * ema - ema of ema."""
    return _array_fn(lambda m: _dema(m, alpha))(x)


def mean_split(x: Column, widths: Sequence[int]) -> Column:
    """STRUCT<trend, residual>: the average of centred means of several widths, and the rest."""
    ks = [_odd(k) for k in widths]

    def fn(m):
        trend = np.mean([_centred(m, k) for k in ks], axis=0)
        return {"trend": trend, "residual": m - trend}
    return _struct_fn(fn, {"trend": _ARRAY, "residual": _ARRAY})(x)


def three_way_split(x: Column, trend: str, alpha: float, k: int, top_k: int, low: float, tau: float) -> Column:
    """STRUCT<trend, seasonal, residual>; seasonal is the energy-filtered part of what the trend leaves."""
    smooth = {"ema": lambda m: _ema(m, alpha), "dema": lambda m: _dema(m, alpha), "sma": lambda m: _centred(m, _odd(k))}[trend]

    def fn(m):
        t = smooth(m)
        s = _energy_filter(m - t, top_k, low, tau)
        return {"trend": t, "seasonal": s, "residual": m - t - s}
    return _struct_fn(fn, {"trend": _ARRAY, "seasonal": _ARRAY, "residual": _ARRAY})(x)


def _penta_factors(n: int, lamb: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L D L' of I + lamb * D'D, which has two diagonals on either side: D, and L's first and second lower diagonal."""
    main = np.full(n, 1.0)
    one, two = np.zeros(n), np.zeros(n)
    for w, at in ((1.0, 0), (4.0, 1), (1.0, 2)):  # a second difference at t touches t, t + 1, t + 2 by 1, -2, 1
        main[at : n - 2 + at] += lamb * w
    one[: n - 2] -= 2 * lamb
    one[1 : n - 1] -= 2 * lamb
    two[: n - 2] += lamb
    d, e, f = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        d[i] = main[i] - (d[i - 1] * e[i - 1] ** 2 if i > 0 else 0.0) - (d[i - 2] * f[i - 2] ** 2 if i > 1 else 0.0)
        if i < n - 1:
            e[i] = (one[i] - (d[i - 1] * e[i - 1] * f[i - 1] if i > 0 else 0.0)) / d[i]
        if i < n - 2:
            f[i] = two[i] / d[i]
    return d, e, f


def _smooth_trend(m: np.ndarray, lamb: float) -> np.ndarray:
    """Solutions of (I + lamb * D'D) y = x for all rows at once, by elimination along the five diagonals."""
    n = m.shape[1]
    if n < 3:
        return m.copy()
    d, e, f = _penta_factors(n, lamb)
    y = m.T.copy()
    for i in range(1, n):
        y[i] -= e[i - 1] * y[i - 1]
        if i > 1:
            y[i] -= f[i - 2] * y[i - 2]
    y /= d[:, None]
    for i in range(n - 2, -1, -1):
        y[i] -= e[i] * y[i + 1]
        if i < n - 2:
            y[i] -= f[i] * y[i + 2]
    return y.T


def hodrick_prescott(x: Column, lamb: float = 6400.0) -> Column:
    """STRUCT<trend, residual>: trend solves (I + lamb * D'D) trend = x with second differences D."""
    def fn(m):
        trend = _smooth_trend(m, lamb)
        return {"trend": trend, "residual": m - trend}
    return _struct_fn(fn, {"trend": _ARRAY, "residual": _ARRAY})(x)


# ---- normalising and pooling ---------------------------------------------------------------------------------------

def standardised(x: Column, mode: str, eps: float, unbiased: bool) -> Column:
    """STRUCT<x, centre, scale>: centred on the mean or the last value, over sqrt(variance + eps)."""
    def fn(m):
        centre = m.mean(axis=1) if mode == "mean" else m[:, -1]
        scale = np.sqrt(m.var(axis=1, ddof=1 if unbiased else 0) + eps)
        return {"x": (m - centre[:, None]) / scale[:, None], "centre": centre, "scale": scale}
    return _struct_fn(fn, {"x": _ARRAY, "centre": "double", "scale": "double"})(x)


def restored(x: Column, centre: Column, scale: Column) -> Column:
    """x * scale + centre."""
    def call(s: pd.Series, c: pd.Series, k: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        lens = s.map(len).to_numpy()
        flat = np.concatenate(s.to_list()) * np.repeat(k.to_numpy(), lens) + np.repeat(c.to_numpy(), lens)
        return pd.Series(np.split(flat, np.cumsum(lens)[:-1]))
    return F.pandas_udf(call, _ARRAY)(x, centre, scale)


def pooled(x: Column, k: int, beta: float) -> Column:
    """STRUCT<avg, max, hybrid, mean, std, top>: non-overlapping pools of ``k`` values, a short last one dropped, and
    mean, sample deviation and maximum of (avg + max) / 2."""
    def fn(m):
        n = m.shape[1] // k
        blocks = m[:, :n * k].reshape(len(m), n, k)
        a, top = blocks.mean(axis=2), blocks.max(axis=2)
        mid = (a + top) / 2
        std = mid.std(axis=1, ddof=1) if n > 1 else np.full(len(m), None)
        return {"avg": a, "max": top, "hybrid": beta * a + (1 - beta) * top, "mean": mid.mean(axis=1), "std": std,
                "top": mid.max(axis=1)}
    return _struct_fn(fn, {"avg": _ARRAY, "max": _ARRAY, "hybrid": _ARRAY, "mean": "double", "std": "double", "top": "double"})(x)


def squared_error(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    def call(s: pd.Series, t: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype="float64")
        row = np.repeat(np.arange(len(s)), s.map(len).to_numpy())
        return pd.Series(np.bincount(row, np.square(np.concatenate(s.to_list()) - np.concatenate(t.to_list())), len(s)))
    return F.pandas_udf(call, "double")(a, b)


# ---- spectra -------------------------------------------------------------------------------------------------------

def amplitude(x: Column, log1p: bool = True) -> Column:
    """Amplitudes of the real DFT, bins 0..n//2."""
    def fn(m):
        a = np.abs(np.fft.rfft(m, axis=1))
        return np.log1p(a) if log1p else a
    return _array_fn(fn)(x)


def phase(x: Column, floor: float = 1e-9) -> Column:
    """Phase per bin; NaN (turned null by the caller) where the amplitude is about 0 and the phase is noise."""
    def fn(m):
        z = np.fft.rfft(m, axis=1)
        return np.where(np.abs(z) > floor * np.maximum(1.0, np.abs(m).sum(axis=1, keepdims=True)), np.angle(z), np.nan)
    return _array_fn(fn)(x)


def energy_filtered(x: Column, top_k: int = 5, low: float = 0.4, tau: float = 0.95) -> Column:
    """Keep low bins while their share of the non-DC energy stays within ``tau``, and the lowest bins in any case."""
    return _array_fn(lambda m: _energy_filter(m, top_k, low, tau))(x)


def strongest_bins(x: Column, top_k: int = 5, low: float = 0.4) -> Column:
    """STRUCT<seasonal, trend>: the ``top_k`` strongest bins among the low ones, DC left out, the lower bin first among
    equals; and the rest."""
    def fn(m):
        amp = np.abs(np.fft.rfft(m, axis=1))
        bins = amp.shape[1]
        cut = min(max(top_k, int(bins * low)), bins)
        picked = np.argsort(-amp[:, 1:cut], axis=1, kind="stable")[:, :top_k] + 1
        keep = np.zeros(amp.shape, dtype=bool)
        np.put_along_axis(keep, picked, True, axis=1)
        seasonal = _keep_bins(m, keep)
        return {"seasonal": seasonal, "trend": m - seasonal}
    return _struct_fn(fn, {"seasonal": _ARRAY, "trend": _ARRAY})(x)


def low_passed(x: Column, cut: int) -> Column:
    """Only the first ``cut`` bins."""
    return _array_fn(lambda m: _keep_bins(m, np.arange(m.shape[1] // 2 + 1) < cut))(x)


def _delays(m: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """The int(factor * ln n) delays of highest circular autocorrelation, smaller delay first among equals, and the
    softmax of their correlations. Delays d and n - d are equal in exact arithmetic and are made so."""
    n = m.shape[1]
    c = np.fft.irfft(np.abs(np.fft.rfft(m, axis=1)) ** 2, n=n, axis=1)
    c = (c + np.roll(c[:, ::-1], 1, axis=1)) / 2
    delay = np.argsort(-c, axis=1, kind="stable")[:, :int(factor * math.log(n))]
    top = np.take_along_axis(c, delay, axis=1)
    w = np.exp(top - top[:, :1])
    return delay, w / w.sum(axis=1, keepdims=True)


def strongest_delays(x: Column, factor: int = 1) -> Column:
    """STRUCT<delay, weight>: arrays over the strongest delays of the circular autocorrelation."""
    def fn(m):
        delay, weight = _delays(m, factor)
        return {"delay": delay, "weight": weight}
    return _struct_fn(fn, {"delay": "array<int>", "weight": _ARRAY})(x)


def delay_aggregated(x: Column, factor: int = 1) -> Column:
    """Weighted sum of the series rolled by each of its strongest delays."""
    def fn(m):
        delay, weight = _delays(m, factor)
        n = m.shape[1]
        at = (np.arange(n)[None, None, :] + delay[:, :, None]) % n
        return (np.take_along_axis(m[:, None, :], at, axis=2) * weight[:, :, None]).sum(axis=1)
    return _array_fn(fn)(x)


def inverse_normal(p: float) -> float:
    """Quantile of the standard normal distribution, for thresholds computed on the driver."""
    return NormalDist().inv_cdf(p)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights at distances -r..r, r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [v / sum(w) for v in w]
