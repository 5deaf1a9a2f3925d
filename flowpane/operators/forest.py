"""Isolation forest: trees grown in parallel on small hash samples, scored by a vectorised walk."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpane.operators.sampling import sample_exact

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int"
_EULER = 0.5772156649015329


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + _EULER) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, split, left, right, size) of one tree; feature -1 marks a leaf."""
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if parent is not None:
            nodes[parent][side] = me
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else np.array([], dtype=int)
        if depth >= limit or not len(spread):
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        low = part[:, f] <= cut
        nodes[me][0], nodes[me][1] = f, cut
        todo.append((rows[~low], depth + 1, me, 3))
        todo.append((rows[low], depth + 1, me, 2))
    return [tuple(n) for n in nodes]


def iforest_fit(df: DataFrame, features: Sequence[str], key: str, trees: int = 300, sample: int = 256,
                seed: int = 0) -> DataFrame:
    """Node table of ``trees`` trees, each grown on at most ``sample`` rows.

    The trees * sample rows with the smallest key hashes form a pool, and every tree draws its own sample of the pool: the
    rows with the smallest hashes of key and tree. Only hashes below a bound that about four samples reach are sorted.
    """
    pool_size = trees * sample
    slim = df.select(F.col(key).cast("string").alias("_key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    pool = sample_exact(slim, "_key", {"all": pool_size}, seed)
    total = pool.count()
    bound = int(-2.0**63 + 2.0**64 * min(1.0, 4 * sample / max(total, 1))) - 1
    trial = F.xxhash64("_key", "tree", F.lit(seed))
    every = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_d", trial)
    place = Window.partitionBy("tree").orderBy("_d", "_key")
    dealt = every.where(F.col("_d") <= bound).withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= sample)
    limit = math.ceil(math.log2(max(min(sample, total), 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack([np.asarray(v) for v in pdf.sort_values("_key")["x"]])
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "size"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return dealt.select("tree", "_key", "x").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def iforest_score(df: DataFrame, features: Sequence[str], nodes: DataFrame, out: str = "score") -> DataFrame:
    """Adds the anomaly score in (0, 1): larger is more anomalous.

    A forest has at most trees * (2 * sample - 1) nodes, whatever the data; it is sent to every task.
    """
    table = nodes.toPandas()
    trees = int(table["tree"].max()) + 1
    width = int(table["node"].max()) + 1
    grid = {c: np.full((trees, width), fill, dtype=kind) for c, fill, kind in (
        ("feature", -1, np.int32), ("split", 0.0, np.float64), ("left", -1, np.int32), ("right", -1, np.int32), ("size", 0, np.int32))}
    for c, g in grid.items():
        g[table["tree"].to_numpy(), table["node"].to_numpy()] = table[c].to_numpy()
    psi = int(grid["size"][:, 0].max())
    model = df.sparkSession.sparkContext.broadcast(grid)
    norm = float(_path_length(np.array([psi]))[0]) or 1.0

    def score(s: pd.Series) -> pd.Series:
        g = model.value
        x = np.stack([np.asarray(v, dtype=np.float64) for v in s])
        rows = np.arange(len(x))
        depth = np.zeros(len(x))
        for t in range(g["feature"].shape[0]):
            at = np.zeros(len(x), dtype=np.int32)
            while True:
                f = g["feature"][t, at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= g["split"][t, at]
                at = np.where(inner, np.where(low, g["left"][t, at], g["right"][t, at]), at)
                depth += inner
            depth += _path_length(g["size"][t, at])
        return pd.Series(np.power(2.0, -depth / g["feature"].shape[0] / norm))

    fn = F.pandas_udf(score, "double")
    return df.withColumn(out, fn(F.array(*[F.col(f).cast("double") for f in features])))
