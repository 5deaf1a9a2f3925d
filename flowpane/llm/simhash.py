"""SimHash near-duplicates, linked by pigeonring filtering.

The 64 bits lie on a ring of three segments. If two fingerprints differ in at most 2 bits, then from some segment on, every
chain of l segments differs in at most 2 l / 3 bits, rounded down: none in the first, one in the first two, two in all.
So a pair is looked up under the first two segments of a chain (43 bits, the second with one bit flipped or none), and only
what meets there comes to the full check. The look-up table grows with the number of different fingerprints, never with
pairs, and a fingerprint has at most 2,080 others within 2 bits, so the links grow in proportion, too.

Defined results: a null or empty text, and one of white space alone, has the fingerprint zero and is linked like any other;
a component without any doc_id has a null component_id; repeated rows are rows of one component; an empty table gives an
empty result. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import stage, text_groups, text_or_empty
from flowpane.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: (shift, bits) of the segments, from the highest bits down; chains go round.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
_COUNT_ROWS = 16_384


def fingerprint(text: str, k: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned number."""
    import xxhash
    words = text.encode().lower().split()  # of bytes: only A-Z change, only space and \\t-\\r separate
    if not words:
        return 0
    if len(words) <= k:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -k]]).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _COUNT_ROWS):
        some = hashes[at : at + _COUNT_ROWS].astype(">u8").view(np.uint8)
        bits += np.unpackbits(some).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _fingerprint_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_groups(batch.column(1)):
                prints = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(prints)], names=["doc_id", "print"])
    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, print): the fingerprint of every text as a signed 64-bit number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprint_batches(k), "doc_id long, print long")


def _segment(x: Column, i: int) -> Column:
    shift, bits = SEGMENTS[i % 3]
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _differ(a: Column, b: Column, i: int) -> Column:
    return F.bit_count(_segment(a, i).bitwiseXOR(_segment(b, i)))


def _chain(a: Column, b: Column, i: int) -> Column:
    """Whether the chain from segment ``i`` on stays within its budgets."""
    return (_differ(a, b, i) == 0) & (_differ(a, b, i + 1) <= 1)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of different fingerprints (column print, all different) at ``MAX_BITS`` bits or fewer, a < b as signed numbers."""
    def key(x: Column, i: int, flip: int) -> Column:
        second = _segment(x, i + 1).bitwiseXOR(F.lit(flip))
        return F.shiftleft(_segment(x, i), SEGMENTS[(i + 1) % 3][1]).bitwiseOR(second)

    def rows(flipped: bool, name: str) -> DataFrame:
        x = F.col("print")
        keys = [F.struct(F.lit(i).alias("chain"), key(x, i, flip).alias("key")) for i in range(3)
                for flip in [0, *([1 << b for b in range(SEGMENTS[(i + 1) % 3][1])] if flipped else [])]]
        return prints.select(x.alias(name), F.explode(F.array(*keys)).alias("at")).select(name, "at.chain", "at.key")

    # Spark sizes exploded rows by the file they come from: unless told, it sends 67 rows of each fingerprint through the driver
    met = rows(False, "a").hint("merge").join(rows(True, "b").hint("merge"), ["chain", "key"]).filter("a < b")
    a, b = F.col("a"), F.col("b")
    # a pair may meet under several chains: it counts under the first
    first = F.when(_chain(a, b, 0), 0).when(_chain(a, b, 1), 1).otherwise(2)
    return met.filter((F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS) & (F.col("chain") == first)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = stage(fingerprints(docs, k), "prints")
    nodes = stage(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(stage(links(nodes.select("print")), "pairs"))
    # tables with a row for each document or fingerprint are merged: their files are small for what they hold
    rooted = nodes.hint("merge").join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stage(rooted.join(least, "root").select("print", "component_id"), "of-print")
    return prints.hint("merge").join(of_print, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the row of its smallest doc_id (one row of it, if it repeats).

    Rows without a doc_id can't be told from the rest of their component and stay.
    """
    found = near_duplicates(docs.filter("doc_id IS NOT NULL"), k).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(found, docs["doc_id"] == found["__kept"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
