"""Maximum mean discrepancy (MMD) between two groups of rows, over all rows, in passes of linear cost.

With a Gaussian kernel k(x, y) = exp(-gamma |x - y|^2) the squared discrepancy is the mean of k over pairs within a, plus that
within b, minus twice that between them. Pairs are never formed:

* For vectors, random Fourier features stand for the kernel: k(x, y) is the mean over frequencies w, drawn from a normal
  distribution of variance 2 gamma, of cos(w (x - y)), so the discrepancy is the mean over frequencies of the squared distance of
  two points (mean cos w x, mean sin w x), one per side: one vector of sums a side, from a single aggregate.
* For single numbers, a fast Gauss transform: the line is cut into cells, a cell keeps a few moments of its values, and cells near
  each other interact through the Taylor series of the kernel.

Rows whose value or vector is null, or holds a null or a number that is not finite, take no part. A group that lacks a side has
null results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowpane.operators.ordered import null_safe_join
from flowpane.session import materialise

FREQUENCIES = 1024
#: Width of a cell in units of the kernel's; orders of the moments; distance, in the same units, beyond which the kernel is below 1e-18.
CELL, ORDERS, REACH = 0.25, 12, 6.5


#: Rows whose features are held at once: arrays stay in the processor's cache, and below the size from which the system maps fresh pages.
CHUNK_ROWS = 12
#: Points of the unit circle in a table; from the nearest one, a series of two terms is off by less than 2e-13.
CIRCLE = 1 << 15


@lru_cache(maxsize=1)
def _circle() -> tuple[np.ndarray, np.ndarray]:
    turns = 2 * np.pi * np.arange(CIRCLE) / CIRCLE
    return np.cos(turns), np.sin(turns)


@lru_cache(maxsize=2)
def _work(shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.empty((5, *shape)), np.empty(shape, np.int64)


def cos_sin(phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of every phase by look-up and a small turn, in a fraction of the time of numpy's two calls, which serve
    phases that are too large for it or not finite. The arrays are used again by the next call."""
    (turn, near, c, s, x), at = _work(phase.shape)
    np.multiply(phase, CIRCLE / (2 * np.pi), out=turn)
    if not (turn.max(initial=0.0) < 2.0**30 and turn.min(initial=0.0) > -(2.0**30)):
        return np.cos(phase), np.sin(phase)
    np.rint(turn, out=near)
    turn -= near
    turn *= 2 * np.pi / CIRCLE
    np.copyto(at, near, casting="unsafe")
    at &= CIRCLE - 1
    for table, out in zip(_circle(), (c, s), strict=True):
        table.take(at, out=out, mode="clip")
    # for a turn t: cos - t (sin + cos t / 2), sin + t (cos - sin t / 2)
    np.multiply(turn, 0.5, out=near)
    np.multiply(c, near, out=x)
    x += s
    x *= turn
    near *= s
    np.subtract(c, near, out=near)
    near *= turn
    c -= x
    s += near
    return c, s


@lru_cache(maxsize=4)
def frequencies(n: int, dims: int, seed: int) -> np.ndarray:
    """``n`` standard normal vectors (columns) drawn from MD5 hashes, the same in any engine that has it."""
    def uniform(j: int, c: int, part: int) -> float:
        return (int(hashlib.md5(f"{j}/{c}/{part}:{seed}".encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32

    return np.array([[math.sqrt(-2 * math.log(uniform(j, c, 0))) * math.cos(2 * math.pi * uniform(j, c, 1)) for j in range(n)]
                     for c in range(dims)]).reshape(dims, n)


def width(mean_square: Column) -> Column:
    """Kernel width from the mean squared distance between the sides."""
    return 1.0 / (2 * mean_square + 1e-10)


# ---- vectors -------------------------------------------------------------------------------------------------------

def _sums(df: DataFrame, by: Sequence[str], columns: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: str | None = None,
          times: str | None = None) -> DataFrame:
    """(by, s): per group, a struct array of (pos, a, b), the sums over each side of the rows of ``columns(matrix, scales)``;
    position 0 counts rows. A row counts as often as ``times`` says. Only one partial sum per batch and group leaves a task."""
    by = list(by)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select([*by, "side"])
            code = keys.to_pandas().groupby([*by, "side"], dropna=False, sort=False).ngroup().to_numpy()
            groups, first = np.unique(code, return_index=True)
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scales = batch.column(scale).to_numpy(zero_copy_only=False) if scale else np.ones(batch.num_rows)
            of_group, sums = (groups[:, None] == code).astype(np.float64), 0.0
            if times:
                of_group *= batch.column(times).to_numpy(zero_copy_only=False)
            for at in range(0, len(code), CHUNK_ROWS):
                here = slice(at, at + CHUNK_ROWS)
                sums = sums + np.concatenate([of_group[:, here].sum(axis=1, keepdims=True), of_group[:, here] @ columns(vectors[here], scales[here])], axis=1)
            out = pa.Table.from_batches([keys]).take(pa.array(first)).append_column("sums", pa.array(list(sums), pa.list_(pa.float64())))
            yield from out.to_batches()

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"side {kinds['side']}", "sums array<double>"])
    wanted = dict.fromkeys([*by, "side", "vector", *([scale] if scale else []), *([times] if times else [])])
    parts = df.select(*wanted).mapInArrow(run, schema)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("v")))
    sums = parts.select(*by, "side", F.posexplode("sums").alias("pos", "v")).groupBy(*by, "pos").agg(side("a").alias("a"), side("b").alias("b"))
    return sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("s"))


def _gaps(s: str = "s") -> Column:
    """Per position after the first, mean of a minus mean of b."""
    head = F.element_at(s, 1)
    return F.transform(F.slice(s, 2, F.size(s) - 1), lambda p: F.try_divide(p["a"], head["a"]) - F.try_divide(p["b"], head["b"]))


def mmd(vectors: DataFrame, by: Sequence[str] = (), gamma: float | None = None, n_frequencies: int = FREQUENCIES, seed: int = 0,
        times: str | None = None) -> DataFrame:
    """(by, gamma, mmd2, mmd, error): discrepancy of the sides 'a' and 'b' of every group of ``vectors`` (by, side, vector).

    All rows count, each as often as the column ``times`` says if one is named. Without ``gamma``, the width comes from the mean squared distance between the sides, E|a|^2 + E|b|^2 - 2 E a . E b.
    ``mmd2`` is a mean over frequencies, unbiased over their draw, of terms between 0 and 4 (so off by more than
    t with probability at most 2 exp(-n t^2 / 8)); ``error`` is its standard error, measured from the same terms.
    """
    by = list(by)
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(*by, "side", F.col("vector").cast("array<double>").alias("vector"), *([times] if times else [])).where(
        whole & F.col("side").isin("a", "b"))
    if gamma is None:
        halves = lambda s, f: F.aggregate(F.slice(s, 2, ((F.size(s) - 1) / 2).cast("int")), F.lit(0.0), f)
        squares = lambda s: F.slice(s, F.size(s) - ((F.size(s) - 1) / 2).cast("int") + 1, ((F.size(s) - 1) / 2).cast("int"))
        na, nb = F.element_at("s", 1)["a"], F.element_at("s", 1)["b"]
        between = (F.aggregate(squares("s"), F.lit(0.0), lambda t, p: t + F.try_divide(p["a"], na) + F.try_divide(p["b"], nb))
                   - 2 * halves("s", lambda t, p: t + F.try_divide(p["a"], na) * F.try_divide(p["b"], nb)))
        widths = materialise(_sums(rows, by, lambda x, _: np.concatenate([x, x * x], axis=1), times=times).select(*by, width(between).alias("gamma")))
        if by:
            rows = null_safe_join(rows, widths, by)
        else:
            head = widths.first()
            rows = rows.withColumn("gamma", F.lit(head["gamma"] if head else None).cast("double"))
        rows = rows.where("gamma is not null")
    else:
        rows = rows.withColumn("gamma", F.lit(float(gamma)))

    def features(x: np.ndarray, gammas: np.ndarray) -> np.ndarray:
        phase = (x * np.sqrt(2 * gammas)[:, None]) @ frequencies(n_frequencies, x.shape[1], seed)
        return np.concatenate(cos_sin(phase), axis=1)

    sums = _sums(rows, [*by, "gamma"], features, "gamma", times).withColumn("_g", _gaps())
    terms = F.zip_with(F.slice("_g", 1, n_frequencies), F.slice("_g", n_frequencies + 1, n_frequencies), lambda c, s: c * c + s * s)
    sums = sums.withColumn("_t", terms)
    total = F.aggregate("_t", F.lit(0.0), lambda t, x: t + x)
    sums = sums.withColumn("mmd2", total / n_frequencies)
    spread = F.aggregate("_t", F.lit(0.0), lambda t, x: t + (x - F.col("mmd2")) * (x - F.col("mmd2")))
    return sums.select(*by, "gamma", "mmd2", F.sqrt("mmd2").alias("mmd"), (F.sqrt(spread) / n_frequencies).alias("error"))


# ---- single numbers ------------------------------------------------------------------------------------------------

def interactions() -> np.ndarray:
    """Per distance of cells (in cells, from 0 on) the matrix that takes moments of both to their kernel sum."""
    reach = math.ceil(REACH / CELL)
    out = np.zeros((reach + 1, ORDERS, ORDERS))
    for o in range(reach + 1):
        t = o * CELL
        hermite = [math.exp(-t * t), 2 * t * math.exp(-t * t)]
        for n in range(1, ORDERS):
            hermite.append(2 * t * hermite[n] - 2 * n * hermite[n - 1])
        for j in range(ORDERS):
            for k in range(ORDERS - j):
                out[o, j, k] = CELL ** (j + k) * hermite[j + k] * (-1) ** k / (math.factorial(j) * math.factorial(k))
    return out


def mmd_per_feature(tall: DataFrame, gamma: float | None = None, feature: str = "feature") -> DataFrame:
    """(feature, gamma, mmd2, mmd): one-dimensional discrepancy of every feature of ``tall`` (feature, side, value), all in one job.

    All rows count, to within 1e-8 of the sum over all pairs: the Taylor series is cut after 12 terms in steps of a quarter of the kernel's
    width (each pair is off by less than 1.1 sum over n >= 12 of 0.354^n / sqrt(n!) < 3e-10), and cells further apart than 6.5 widths
    are left out (kernel < 1e-18). Moments are summed before the shuffle; cells are at most as many as different values.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = tall.select(feature, "side", F.col("value").cast("double").alias("value")).where(finite & F.col("side").isin("a", "b"))
    of = lambda s: F.when(F.col("side") == s, F.col("value"))
    facts = rows.groupBy(feature).agg(
        F.count(of("a")).alias("n_a"), F.count(of("b")).alias("n_b"), F.avg("value").alias("centre"),
        (F.var_pop(of("a")) + F.var_pop(of("b")) + F.pow(F.avg(of("a")) - F.avg(of("b")), 2)).alias("between"))
    facts = materialise(facts.where("n_a > 0 and n_b > 0").withColumn("gamma", width(F.col("between")) if gamma is None else F.lit(float(gamma))))
    place = (F.col("value") - F.col("centre")) * F.sqrt("gamma") / CELL
    placed = null_safe_join(rows, facts, [feature]).withColumn("_p", place).withColumn("cell", F.floor("_p"))
    placed = placed.withColumn("_d", F.col("_p") - F.col("cell") - 0.5).withColumn(
        "_w", F.when(F.col("side") == "a", 1.0 / F.col("n_a")).otherwise(-1.0 / F.col("n_b")))
    powers = [F.sum(F.col("_w") * F.pow("_d", F.lit(j))) if j else F.sum("_w") for j in range(ORDERS)]
    cells = materialise(placed.groupBy(feature, "cell").agg(F.array(*powers).alias("m")))
    forms = interactions()

    @F.pandas_udf("double")
    def sums(m: pd.Series, other: pd.Series, distance: pd.Series) -> pd.Series:
        if not len(m):
            return pd.Series([], dtype="float64")
        return pd.Series(np.einsum("nj,njk,nk->n", np.stack(m), forms[distance.to_numpy()], np.stack(other)))

    # x = left cell, y = right cell: a pair of different cells stands for both orders
    left = cells.select(feature, "m", F.explode(F.sequence(F.lit(0), F.lit(len(forms) - 1))).alias("o"), "cell").withColumn("cell", F.col("cell") + F.col("o"))
    met = null_safe_join(left, cells.withColumnRenamed("m", "other"), [feature, "cell"])
    part = sums("m", "other", "o") * F.when(F.col("o") == 0, 1.0).otherwise(2.0)
    total = met.groupBy(feature).agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mmd2"))
    return null_safe_join(facts.select(feature, "gamma"), total, [feature]).withColumn("mmd", F.sqrt("mmd2"))
