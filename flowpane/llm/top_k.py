"""Exact top-k search by inner product with an impact-ordered index, score at a time.

Rows are dealt into blocks. A block's index has, per component, its values in binary above the least one; the rows with a bit set are a
posting segment, whose impact for a query is the query's component times that power of two. A search takes the segments of all components
by descending power, a stretch of them at a time, for many queries at once as a matrix product. After a stretch every row has a lower
and an upper bound of its score, from what has been processed and from the most and the least that the bits not yet processed can add.
Rows whose upper bound is below the k-th best lower bound leave, nor does a row stay that can't beat the k best of the rows before it;
the search stops only on that proof, when few rows are left, or when all segments are processed, and scores what is left exactly.
Queries are a stated set (by default ids divisible by 20) and meet the rows in blocks.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors of different lengths are not compared; a row with the query's vec_id is its own and no candidate; repeated
candidates and repeated queries are ranked each; scores are 64-bit, so components are meant to stay below 2^28; an empty table
gives an empty result. Only vec_id and the vector column are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowpane.llm.common import ragged_index, stage

K = 20
EVERY = 20
SCALE = 64
#: Rows of a block and queries that meet it in a task, and numbers that either holds, unless that leaves less than a quarter of the rows.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_VALUES = 32_768, 8_192, 1 << 21
#: Bits of all components that are processed in a stretch.
STRETCH_BITS = 6
#: Rows of a block and queries that are scored at once, and the share of their pairs that is few enough to be scored one by one.
PART_ROWS, PART_QUERIES, FEW = 8_192, 128, 1 / 128
#: The least k-th best row among the best of so many sets of rows is a lower bound of the k-th best row.
SETS = 512
#: Numbers up to which floats are whole numbers.
WHOLE = {np.float32: 1 << 24, np.float64: 1 << 53}


class ImpactIndex:
    """Posting segments of a block of integer vectors: the bits of every row above the least value, in every component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # a later row does not win a tie
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        # Python's numbers: a difference may be beyond 64 bits
        self.bits = max(int(h) - int(m) for m, h in zip(self.low.tolist(), high.tolist(), strict=True)).bit_length()
        self.largest = max(abs(int(self.low.min())), abs(int(high.max())))
        self._levels: dict = {}

    def levels(self, shift: int, start: int, stop: int, kind: type) -> np.ndarray:
        """(component, row): the bits from ``shift`` on of some rows, as a number."""
        key = (shift, start, kind)
        if key not in self._levels:
            self._levels[key] = np.ascontiguousarray(((self.vectors[start:stop] - self.low) >> shift).T, kind)
        return self._levels[key]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, ties to smaller ids."""
        _, ids, scores = self.search_all(np.array([query_id]), query[None, :], k)
        return ids, scores

    def search_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, ids, scores) of the k best rows for each query, by query and rank."""
        found = [self._search_part(query_ids[at : at + PART_QUERIES], queries[at : at + PART_QUERIES], k) for at in range(0, len(queries), PART_QUERIES)]
        return (np.concatenate([asked + i * PART_QUERIES for i, (asked, _, _) in enumerate(found)]),
                np.concatenate([self.ids[rows] for _, rows, _ in found]), np.concatenate([scores for _, _, scores in found]))

    def _search_part(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, most = len(queries), np.iinfo(np.int64)
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound, full = np.full(n, most.min), np.zeros(n, bool)  # the k-th best score so far, where there are k
        first, last = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        own = np.repeat(np.arange(n), last - first), ragged_index(first, last - first)
        for start in range(0, len(self.ids), PART_ROWS):
            stop = min(start + PART_ROWS, len(self.ids))
            here = (own[1] >= start) & (own[1] < stop)
            asked, rows, scores = self._left(queries, start, stop, (own[0][here], own[1][here] - start), bound, full, k)
            better = ~full[asked] | (scores > bound[asked])
            kept = tuple(np.concatenate(x) for x in zip(kept, (asked[better], rows[better], scores[better]), strict=True))
            if better.any():
                order = np.lexsort((kept[1], ~kept[2], kept[0]))  # rows are in the order of their ids; ~x falls as x rises, at any x
                kept = tuple(x[order] for x in kept)
                counts = np.bincount(kept[0], minlength=n)
                ends = np.cumsum(counts)
                rank = np.arange(len(order)) - np.repeat(ends - counts, counts)
                full = counts >= k
                bound[full] = kept[2][(ends - counts + k - 1)[full]]
                kept = tuple(x[rank < k] for x in kept)
        return kept

    def _left(self, queries: np.ndarray, start: int, stop: int, own: tuple[np.ndarray, np.ndarray], bound: np.ndarray, full: np.ndarray,
              k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the rows from ``start`` to ``stop`` that may be among the k best of a query."""
        n, m = len(queries), stop - start
        left = np.ones((n, m), bool)
        left[own] = False
        sums, shift = np.abs(queries.astype(np.float64)).sum(axis=1).max(), self.bits
        base = None
        # beyond that no bound is sure to be a 64-bit number
        while (shift or base is None) and sums * 2.0 * max(self.largest, 1) < 2.0**60:
            shift = max(0, shift - STRETCH_BITS)
            kind = next((t for t, whole in WHOLE.items() if sums * 2.0 ** (self.bits - shift) < whole), None)
            if kind is None:
                break
            if base is None:
                base, adds, takes = queries @ self.low, np.maximum(queries, 0).sum(axis=1), np.minimum(queries, 0).sum(axis=1)
            level = queries.astype(kind) @ self.levels(shift, start, stop, kind)
            level[own] = -np.inf
            rest = (1 << shift) - 1
            # what a level must reach, as whole numbers; a tie with rows before does not win
            least = np.where(full, -((base + rest * adds - bound - 1) >> shift), -(1 << 53))
            best = self._kth(level, k)
            some = np.isfinite(best)
            sure = best[some].astype(np.int64) << shift
            least[some] = np.maximum(least[some], -((rest * adds[some] - sure - rest * takes[some]) >> shift))
            whole = WHOLE[kind]
            left = level >= np.clip(least, -whole, whole).astype(kind)[:, None]
            if not shift:
                if np.count_nonzero(left) > FEW * n * m:  # of equal rows the first are enough
                    same = level == best[:, None]
                    left &= ~same | (np.cumsum(same, axis=1, dtype=np.int32) <= k)
                asked, rows = np.divmod(np.flatnonzero(left), m)
                return asked, rows + start, level[asked, rows].astype(np.int64) + base[asked]
            if np.count_nonzero(left) <= FEW * n * m:
                break
        asked, rows = np.divmod(np.flatnonzero(left), m)
        scores = np.empty(len(asked), np.int64)
        for at in range(0, len(asked), PART_ROWS):
            some = slice(at, at + PART_ROWS)
            scores[some] = np.einsum("ij,ij->i", self.vectors[rows[some] + start], queries[asked[some]])
        return asked, rows + start, scores

    @staticmethod
    def _kth(level: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of the k-th greatest number of every row, -inf where there are fewer."""
        n, m = level.shape
        if m >= 2 * SETS and SETS >= 4 * k:
            level = level[:, : m // SETS * SETS].reshape(n, -1, SETS).max(axis=1)
        if level.shape[1] < k:
            return np.full(n, -np.inf)
        return np.partition(level, level.shape[1] - k, axis=1)[:, level.shape[1] - k]


def _search_block(k: int):
    kind = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["query"].is_valid().to_numpy(zero_copy_only=False)
        numbers = table["query"].fill_null(0).to_numpy()
        ids = table["vec_id"].to_numpy()
        values = pc.list_flatten(table["v"]).to_numpy().reshape(len(ids), -1)
        if asks.all() or not asks.any():
            return kind.empty_table()
        asked, found, scores = ImpactIndex(ids[~asks], values[~asks]).search_all(ids[asks], values[asks], k)
        return pa.table([numbers[asks][asked], ids[asks][asked], found, scores], schema=kind)
    return run


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the vectors that take part."""
    x = F.col(column).cast("array<double>")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(whole & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best of ``vectors`` (vec_id, v) for each of ``queries`` (vec_id, v)."""
    vectors = stage(vectors.withColumn("query", F.lit(None).cast("long")), "vectors")
    queries = stage(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    rows, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    asked, share = queries.count(), min(1, max(1 / 4, BLOCK_VALUES / (max(1, width) * BLOCK_ROWS)))
    blocks, groups = (max(1, math.ceil(n / (size * share))) for n, size in ((rows, BLOCK_ROWS), (asked, BLOCK_QUERIES)))

    def dealt(table: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (table.withColumn(own, F.monotonically_increasing_id() % n_own)
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>")))
                .select("block", "group", F.size("v").alias("width"), "query", "vec_id", "v"))

    met = dealt(vectors, "block", blocks, "group", groups).unionByName(dealt(queries, "group", groups, "block", blocks))
    # small rows, much work: as many tasks as there are meetings of blocks
    best = (met.repartition(blocks * groups, "block", "group", "width").groupBy("block", "group", "width")
            .applyInArrow(_search_block(k), "query long, query_id long, vec_id long, score long"))
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", ranked.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
