"""Dense vectors: class prototypes and pairwise cosines, by blocks.

All-pairs quantities are computed on block cells: vectors are dealt into blocks of bounded size, each unordered pair
of blocks is one cell, and a vector is sent to the cells its block takes part in. A cell is one matrix product; what
leaves it is a few sums, unless the pairs themselves are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
#: Where only sums leave a cell, blocks grow before their number passes FEW_BLOCKS, as far as BLOCK_NUMBERS numbers each: a vector is sent
#: once per block, so what is shuffled grows with the rows until the largest blocks are full.
FEW_BLOCKS, BLOCK_NUMBERS = 16, 1 << 21
#: Rows of a block that are multiplied at once.
STRIP_ROWS = 256


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): the mean vector of each class. Partial sums are formed before the shuffle."""
    pieces = df.select(label, F.posexplode(vector).alias("i", "v"))
    g = pieces.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = g.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
    return rows.select(label, F.col("s").getField("v").alias("vector"))


def block_cells(df: DataFrame, blocks: int, block: str = "_block") -> DataFrame:
    """Each row once per cell (``_i`` <= ``_j``) in which its block takes part."""
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    cells = F.transform(every, lambda o: F.struct(F.least(F.col(block), o).alias("i"), F.greatest(F.col(block), o).alias("j")))
    return df.withColumn("_c", F.explode(cells)).withColumns({"_i": F.col("_c.i"), "_j": F.col("_c.j")}).drop("_c")


def with_block(df: DataFrame, key: str, rows: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Deal rows into blocks by a hash of their key: about ``block_rows`` each."""
    blocks = max(1, -(-rows // block_rows))
    return df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks


def summary_block_rows(rows: int, dims: int) -> int:
    """Rows of a block for sums over all pairs: as many as keep the blocks few, within the bound on a block's numbers."""
    return max(BLOCK_ROWS, min(-(-rows // FEW_BLOCKS), BLOCK_NUMBERS // max(1, dims)))


def _unit_cells(df: DataFrame, key: str, vector: str, only_sums: bool = False) -> DataFrame:
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("v"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    size = summary_block_rows(facts["n"], facts["dims"] or 1) if only_sums else BLOCK_ROWS
    blocked, blocks = with_block(rows, "key", facts["n"], size)
    return block_cells(blocked, blocks)


def _sides(pdf: pd.DataFrame):
    """Unit vectors of the two blocks of a cell with their keys, and whether the blocks are one."""
    m = np.stack([np.asarray(a, dtype=np.float64) for a in pdf["v"]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    a = (pdf["_block"] == i).to_numpy()
    b = (pdf["_block"] == j).to_numpy()
    return m[a], m[b], pdf["key"].to_numpy()[a], pdf["key"].to_numpy()[b], i == j


def cosine_summary(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean, largest and smallest cosine over all pairs of different vectors. One small row leaves each cell."""
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, _ka, _kb, same = _sides(pdf)
        strips = []
        for at in range(0, len(a), STRIP_ROWS):
            g = a[at : at + STRIP_ROWS] @ (b[at:] if same else b).T
            v = g[np.triu(np.ones(g.shape, dtype=bool), 1)] if same else g.ravel()
            if len(v):
                strips.append((len(v), v.sum(), v.max(), v.min()))
        if not strips:
            return pd.DataFrame({"n": [0], "s": [0.0], "hi": [None], "lo": [None]})
        n, s, hi, lo = map(np.array, zip(*strips, strict=True))
        return pd.DataFrame({"n": [n.sum()], "s": [s.sum()], "hi": [hi.max()], "lo": [lo.min()]})

    parts = _unit_cells(df, key, vector, only_sums=True).groupBy("_i", "_j").applyInPandas(cell, "n bigint, s double, hi double, lo double")
    return parts.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.max("hi").alias("max"), F.min("lo").alias("min"))


def cosine_matrix(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, cosine) for every ordered pair: the matrix itself, for sets of prototypes."""
    kind = dict(df.dtypes)[key]

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, ka, kb, _same = _sides(pdf)
        g = a @ b.T
        one = pd.DataFrame({"a": np.repeat(ka, len(kb)), "b": np.tile(kb, len(ka)), "cosine": g.ravel()})
        if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
            return one
        return pd.concat([one, one.rename(columns={"a": "b", "b": "a"})[["a", "b", "cosine"]]], ignore_index=True)

    return _unit_cells(df, key, vector).groupBy("_i", "_j").applyInPandas(cell, f"a {kind}, b {kind}, cosine double")
