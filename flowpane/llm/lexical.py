"""Ranked lexical search with hashed max-sketches: bounds for all documents at once, then exact scores by descending bound.

1. Every document is indexed once: its number of terms and, per distinct term (a 64-bit hash), its count. The index is written.
2. Queries come in batches with a bounded number of terms. A pass over the index counts the documents that hold each term.
3. In the search pass, a block of documents folds the impacts of its terms into sketches: a term has a slot, a slot keeps the
   greatest impact (rounded up to a byte). A term's impact is never above its slot's, so the product of the sketches with the
   batch's weights per slot bounds all scores of the block from above.
4. A query takes a block's documents by descending bound, scores them exactly, and stops when the next bound is below its
   k-th best score so far, which it carries from block to block of a task. What tasks found is ranked in the end.

Defined results: a null or empty text, and one without terms, is no candidate and not counted in N; a null, empty or unmatched
item has no rows; rows that repeat a document or an item are ranked each; a document with a null doc_id comes after others of
its score; fewer than k documents with a score above 0 give fewer rows; an empty table gives an empty result. Only the named
columns are read. Texts are split whole; 64-bit hashes stand for terms (two of a billion different terms meet with a chance
of 3 percent, and then count as one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowpane.llm.common import SegmentTable, stage, text_groups

K = 20
#: Distinct query terms of a batch, about; slots of a sketch; documents bounded at once; documents scored in a first step.
BATCH_TERMS = 100_000
SLOTS = 1_024
BLOCK_DOCS = 4_096
FIRST_STEP = 64
#: Impacts are below this; a sketch keeps them in bytes, rounded up.
FULL_IMPACT = 1_000_000
_STEP = FULL_IMPACT / 255
#: Products of sketches and weights are taken in 32-bit floats; bounds are widened by this share, far beyond their error.
_SLACK = 1e-3
#: Every byte to what it counts as: term bytes (A-Z lower-cased) stay, others become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

_INDEX = "id long, n long, terms array<long>, counts array<int>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def _hash_terms(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash
    return np.ones(len(terms), np.int64), np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)).view(np.int64)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = SegmentTable(_hash_terms, np.int64)
    for batch in batches:
        for start, texts in text_groups(batch.column(1)):
            at, n = table.numbers([terms_of(t) for t in texts])
            key, counts = np.unique(np.repeat(np.arange(len(texts)), n) << 32 | at, return_counts=True)
            offsets = np.searchsorted(key >> 32, np.arange(len(texts) + 1))
            hashes = table.ragged.flat[key & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts, pa.int32()))], names=["id", "n", "terms", "counts"])


def index_terms(rows: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """(id, n, terms, counts): the number of terms of every text, its distinct terms' hashes and their counts; written once."""
    texts = rows.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return stage(texts.mapInArrow(_index_batches, _INDEX), "terms")


class Batch:
    """The queries of a batch: their distinct terms (sorted hashes) and, as (query, term, count), what each asks for."""

    def __init__(self, rows: list) -> None:
        self.numbers = np.array([r["query"] for r in rows], np.int64)
        sizes = [len(r["terms"]) for r in rows]
        hashes = np.array([t for r in rows for t in r["terms"]], np.int64)
        self.terms, self.term = np.unique(hashes, return_inverse=True)
        self.counts = np.array([c for r in rows for c in r["counts"]], np.int64)
        self.ends = np.cumsum([0, *sizes])
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, n_docs: int, held: dict[int, int]) -> None:
        """Weights of all terms from the documents that hold them."""
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in self.terms.tolist()], np.int64)

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are terms of the batch, and the numbers of those terms."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        hit = np.flatnonzero(self.terms[at] == hashes) if len(self.terms) else np.zeros(0, np.int64)
        return hit, at[hit]

    def slots(self) -> np.ndarray:
        """Weights per slot (rows) and query (columns), for sketches in steps of ``_STEP``."""
        out = np.zeros((SLOTS, len(self.numbers)), np.float32)
        query = np.repeat(np.arange(len(self.numbers)), np.diff(self.ends))
        np.add.at(out, (self.terms[self.term] % SLOTS, query), self.counts * self.weights[self.term] * _STEP * (1 + _SLACK))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids as an Arrow array, n, document of a term, hash of a term, count of a term) of blocks of documents."""
    for whole in batches:
        for start in range(0, len(whole), BLOCK_DOCS):
            batch = whole.slice(start, BLOCK_DOCS)
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            yield (batch.column(0), batch.column(1).to_numpy(), np.repeat(np.arange(len(batch)), sizes),
                   lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64))


def _count_holders(asked: Batch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(asked.terms), np.int64)
        for _, _, _, hashes, _ in _blocks(batches):
            held += np.bincount(asked.found(hashes)[1], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(asked.terms[some]), pa.array(held[some])], names=["term", "held"])
    return run


class Block:
    """Documents with their impacts on the terms of a batch, their sketches, and exact scores on demand."""

    def __init__(self, asked: Batch, n: np.ndarray, doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.asked = asked
        hit, term = asked.found(hashes)
        doc, tf = doc[hit], counts[hit]
        m = 100 - 25 + 25 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        self.sketch = np.zeros((len(n), SLOTS), np.uint8)
        np.maximum.at(self.sketch, (doc, asked.terms[term] % SLOTS), np.ceil(impact / _STEP).astype(np.uint8))
        key = doc * len(asked.terms) + term
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[order]

    def bounds(self, slots: np.ndarray) -> np.ndarray:
        return self.sketch.astype(np.float32) @ slots

    def scores(self, docs: np.ndarray, query: int) -> np.ndarray:
        """Exact scores of ``docs`` for a query."""
        a, b = self.asked.ends[query], self.asked.ends[query + 1]
        term = self.asked.term[a:b]
        key = docs[:, None] * len(self.asked.terms) + term[None, :]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        impact = np.where(self.key[at] == key, self.impact[at], 0)
        return impact @ (self.asked.counts[a:b] * self.asked.weights[term])


_NO_ID = np.iinfo(np.int64).max


def _search_batches(asked: Batch, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = asked.slots()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked.numbers]  # (scores, ids), best first
        for ids, n, doc, hashes, counts in _blocks(batches):
            block = Block(asked, n, doc, hashes, counts, n_docs, n_terms)
            if not len(block.key):
                continue
            ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), _NO_ID, ids.fill_null(0).to_numpy())
            bounds = block.bounds(slots)
            for query in range(len(asked.numbers)):
                best[query] = _improve(block, ids, bounds[:, query], query, *best[query], k)
        sizes = [len(s) for s, _ in best]
        scores, ids = (np.concatenate([b[i] for b in best] or [np.zeros(0, np.int64)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.numbers, sizes)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)],
                                         names=["query", "doc_id", "score"])
    return run


def _improve(block: Block, ids: np.ndarray, bound: np.ndarray, query: int, scores: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those found and the block's documents, taken by descending bound until no bound reaches the k-th."""
    floor = scores[-1] if len(scores) == k else 1
    left = np.flatnonzero(bound >= floor)
    left = left[np.argsort(-bound[left], kind="stable")]
    at, step = 0, FIRST_STEP
    while at < len(left) and bound[left[at]] >= floor:
        some = left[at : at + step]
        at, step = at + step, 2 * step
        new = block.scores(some, query)
        keep = new >= floor
        scores, found = np.concatenate([scores, new[keep]]), np.concatenate([found, ids[some[keep]]])
        order = np.lexsort((found, -scores))[:k]
        scores, found = scores[order], found[order]
        floor = scores[-1] if len(scores) == k else 1
    return scores, found


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``index`` for each of ``items``, both from ``index_terms``."""
    spark = index.sparkSession
    items = stage(items.withColumn("query", F.monotonically_increasing_id()), "items")
    facts = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    asked_terms = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()["t"]
    n_batches = max(1, math.ceil(asked_terms / BATCH_TERMS))
    parts = []
    for i in range(n_batches if facts["terms"] else 0):
        asked = Batch(items.filter(F.col("query") % n_batches == i).filter(F.size("terms") > 0).orderBy("query").collect())
        if not len(asked.terms):
            continue
        held = index.mapInArrow(_count_holders(asked), "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
        asked.weigh(facts["docs"], {r["term"]: r["held"] for r in held.collect()})
        parts.append(index.mapInArrow(_search_batches(asked, facts["docs"], facts["terms"], k), "query long, doc_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    return best.join(items.select("query", F.col("id").alias("item_id")), "query").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return search(index_terms(docs, "doc_id"), index_terms(items, "item_id"))


_TERMS = (r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS.format('text')} AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT d, doc_id, len(ts) AS n, ts FROM docs WHERE len(ts) > 0),
facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format('text')} AS ts FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, t, count(*) AS qtf FROM (SELECT q, item_id, unnest(ts) AS t FROM items) GROUP BY ALL),
held AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM sized) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT t, count(*) AS df FROM held GROUP BY t), facts),
impacts AS (SELECT d, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS impact
            FROM held JOIN sized USING (d), facts),
scored AS (SELECT q, item_id, d, sum(qtf * w * impact)::BIGINT AS score
           FROM asked JOIN weights USING (t) JOIN impacts USING (t) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
           FROM scored JOIN sized USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
