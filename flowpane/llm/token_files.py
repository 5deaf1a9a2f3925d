"""Token ids as binary files: canonical length-limited Huffman codes of the ids, in independent blocks.

The code lengths come from the counts of all ids. A block holds whole documents, each from a byte boundary on; checkpoints
give the bit offset of every ``CHECK_EVERY``-th id of a document, so that a reader may start at any of them, and so that
many stretches are decoded side by side, one table look-up per id. The files are Parquet tables of blocks beside a code
book, so they lie in whatever store Spark writes to.

Defined results: a null or empty text is a document of the end id alone; documents with a null id come first; rows that
repeat a document are documents of their own, next to each other; an empty table gives files without blocks. Only the
columns doc_id and text are read, whatever others are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowpane.llm.common import SegmentTable, ragged_index, scratch_path, stage, sums_by, text_groups, text_or_empty, text_slices
from flowpane.llm.vocab import WORD_BPE, WordEncoder, space_chunk_lists

END_ID = 1
#: Longest code in bits; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Ids between two checkpoints.
CHECK_EVERY = 256
#: A block is closed once it holds so many ids.
BLOCK_IDS = 400_000

_TABLES: dict[str, SegmentTable] = {}


#: Stands for the end of a document among its chunks; no chunk holds white space.
_END = " "
#: Chunks that a worker keeps; only time depends on it.
TABLE_CHUNKS = 800_000


def word_ids_table(tokenizer: str) -> SegmentTable:
    """The worker's table of chunks and their ids, kept between tasks."""
    if tokenizer not in _TABLES:
        encoder = WordEncoder(tokenizer, {_END: [END_ID]})
        _TABLES[tokenizer] = SegmentTable(encoder.values_of, np.int32, TABLE_CHUNKS)
    return _TABLES[tokenizer]


# --- code book ---------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts, by merging packages level by level."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    if n <= 1:
        return np.ones(n, np.uint8)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels, items = [], weights
    for _ in range(max_bits):
        own = np.ones(len(items), bool) if not levels else None
        if levels:
            pairs = levels[-1][0]
            pairs = pairs[: len(pairs) // 2 * 2].reshape(-1, 2).sum(axis=1)
            items = np.concatenate([weights, pairs])
            by = np.argsort(items, kind="stable")
            own, items = by < n, items[by]
        levels.append((items, own))
    lengths, chosen = np.zeros(n, np.uint8), 2 * n - 2
    for _, own in reversed(levels):
        single = int(own[:chosen].sum())
        lengths[:single] += 1
        chosen = 2 * (chosen - single)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class CodeBook:
    """Canonical codes of ``ids`` (ascending) with the given lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.bits = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((ids, lengths))
        size = int(ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        step = np.left_shift(np.uint64(1), (self.bits - lengths[order]).astype(np.uint64))
        first = np.cumsum(step) - step
        self.code[ids[order]] = first >> (self.bits - lengths[order]).astype(np.uint64)
        self.length[ids[order]] = lengths[order]
        filled = int(step.sum())
        self.symbol = np.zeros(1 << self.bits, np.int32)
        self.used = np.ones(1 << self.bits, np.uint8)
        self.symbol[:filled] = np.repeat(ids[order].astype(np.int32), step.astype(np.int64))
        self.used[:filled] = np.repeat(lengths[order], step.astype(np.int64))

    def encode(self, ids: np.ndarray, doc_lens: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bit streams of documents of ``doc_lens`` ids, their sizes in bytes, and all checkpoints within them."""
        lens = self.length[ids]
        bits = sums_by(doc_lens, lens)
        sizes = (bits + 7) >> 3
        base = (np.cumsum(sizes) - sizes) << 3
        ends = np.cumsum(lens)
        starts = ends - lens + np.repeat(base - (np.cumsum(bits) - bits), doc_lens)
        # a code lies in one 64-bit word, or in two neighbours
        room = 64 - (starts & 63)
        over = np.maximum(lens - room, 0).astype(np.uint64)
        code = self.code[ids]
        head = np.where(over > 0, code >> over, code << np.maximum(room - lens, 0).astype(np.uint64))
        total = int(sizes.sum())
        words = np.zeros((total >> 3) + 2, np.uint64)
        at = starts >> 6
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[firsts]] = np.bitwise_or.reduceat(head, firsts)
        tails = np.flatnonzero(over)
        words[at[tails] + 1] |= code[tails] << (np.uint64(64) - over[tails])
        first = np.cumsum(doc_lens) - doc_lens
        marks = lane_starts(doc_lens)[0]
        inside = starts[marks] - np.repeat(base, (doc_lens + CHECK_EVERY - 1) // CHECK_EVERY) if len(first) else marks
        return words.astype(">u8").tobytes()[:total], sizes, inside

    def decode(self, payload: bytes, offsets: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The ids of lanes that start at bit ``offsets`` and have ``lens`` ids each, one after another."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-lens, kind="stable")
        at, left = offsets[order].astype(np.int64), lens[order]
        to = (np.cumsum(lens) - lens)[order]
        out = np.empty(int(lens.sum()), np.int32)
        down = np.uint32(32 - self.bits)
        for k in range(int(lens.max(initial=0))):
            if left[-1] <= k:
                live = int(np.searchsorted(-left, -k, side="left"))
                at, left, to = at[:live], left[:live], to[:live]
            window = (ahead[at >> 3] << (at & 7).astype(np.uint32)) >> down
            out[to + k] = self.symbol[window]
            at = at + self.used[window]
        return out


def lane_starts(doc_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id and length of every lane of documents that lie one after another."""
    lanes = (doc_lens + CHECK_EVERY - 1) // CHECK_EVERY
    nth = ragged_index(np.zeros(len(doc_lens), np.int64), lanes)
    first = np.repeat(np.cumsum(doc_lens) - doc_lens, lanes) + nth * CHECK_EVERY
    return first, np.minimum(CHECK_EVERY, np.repeat(doc_lens, lanes) - nth * CHECK_EVERY)


# --- writing -----------------------------------------------------------------------------------------------------

_IDS = "doc_id long, ids binary, token array<int>, times array<long>"
_CODED = "part int, doc_id long, n long, checks binary, bits binary"
_BLOCK = ("part int, seq int, before long, n_ids long, doc_ids array<long>, doc_lens array<long>, doc_bytes array<long>, "
          "checkpoints binary, payload binary")


def _encode_batches(tokenizer: str):
    """Ids of every text as 16-bit numbers, and a last row with the counts of all ids of the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = word_ids_table(tokenizer), np.zeros(1 << 16, np.int64)
        kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("token", pa.list_(pa.int32())),
                          ("times", pa.list_(pa.int64()))])
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                at, n_chunks = table.numbers_of(space_chunk_lists(texts))
                at, n_chunks = np.insert(at, np.cumsum(n_chunks), table.number(_END)), n_chunks + 1
                ids = table.ragged.take(at)
                if int(ids.max()) >= len(counts):
                    raise ValueError("ids of more than 16 bits")
                counts += np.bincount(ids, minlength=len(counts))
                ends = np.cumsum(sums_by(n_chunks, table.ragged.lens(at))) * 2
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                rows = pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), rows, pa.nulls(len(texts), kind.field(2).type),
                     pa.nulls(len(texts), kind.field(3).type)], schema=kind)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pylist([{"token": met.tolist(), "times": counts[met].tolist()}], kind)
    return run


def _code_batches(book, bounds: np.ndarray):
    """The bit stream of every document, with the part that its id falls into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = CodeBook(*book)
        for batch in batches:
            known = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            parts = np.searchsorted(bounds, known, side="right")
            for start, raw in text_groups(batch.column(1), 1_000_000):
                lens = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
                bits, sizes, checks = codes.encode(np.frombuffer(b"".join(raw), "<u2"), lens)
                lanes = (lens + CHECK_EVERY - 1) // CHECK_EVERY
                cut = lambda data, ends: [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts[start : start + len(raw)], pa.int32()), batch.column(0).slice(start, len(raw)), pa.array(lens),
                     pa.array(cut(checks.astype("<u8").tobytes(), np.cumsum(lanes) * 8), pa.binary()),
                     pa.array(cut(bits, np.cumsum(sizes)), pa.binary())], names=["part", "doc_id", "n", "checks", "bits"])
    return run


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive documents of a part; the rows come by part and document."""
    part, seq, before, held, n_held = None, 0, 0, [], 0

    def block() -> pa.RecordBatch:
        sizes = np.array([len(r["bits"]) for r in held], np.int64)
        lens = np.array([r["n"] for r in held], np.int64)
        checks = np.frombuffer(b"".join(r["checks"] for r in held), "<u8").astype(np.int64)
        checks = checks + np.repeat((np.cumsum(sizes) - sizes) << 3, (lens + CHECK_EVERY - 1) // CHECK_EVERY)
        row = {"part": part, "seq": seq, "before": before, "n_ids": n_held, "doc_ids": [r["doc_id"] for r in held],
               "doc_lens": lens.tolist(), "doc_bytes": sizes.tolist(), "checkpoints": checks.astype("<u8").tobytes(),
               "payload": b"".join(r["bits"] for r in held)}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(
            [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
             ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("doc_bytes", pa.list_(pa.int64())),
             ("checkpoints", pa.binary()), ("payload", pa.binary())]))

    for batch in batches:
        for at in range(0, len(batch), 512):
            for row in batch.slice(at, 512).to_pylist():
                if held and (row["part"] != part or n_held >= BLOCK_IDS):
                    yield block()
                    seq, before, held, n_held = seq + 1, before + n_held, [], 0
                if row["part"] != part:
                    part, seq, before = row["part"], 0, 0
                held.append(row)
                n_held += row["n"]
    if held:
        yield block()


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, parts: int | None = None) -> str:
    """Encode every text of ``docs`` and write its ids, with the end id, in ascending order of doc_id.

    ``path`` gets the tables ``blocks`` and ``book``. The ids are staged once, since the code needs the counts of all of
    them; what is shuffled into order is the coded bit streams. ``parts`` is the number of ranges of doc_id (by default
    the session's shuffle width).
    """
    spark = docs.sparkSession
    staged = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
                   .mapInArrow(_encode_batches(tokenizer), _IDS), "token-ids")
    counts = (staged.filter("token IS NOT NULL").select(F.explode(F.arrays_zip("token", "times")).alias("x"))
              .groupBy(F.col("x.token").alias("token")).agg(F.sum("x.times").alias("times")))
    # one row per id of the vocabulary at most
    found = sorted((r["token"], r["times"]) for r in counts.collect())
    ids, times = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    book = (ids, code_lengths(times))
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(*book, strict=True)], "token int, bits int") \
        .coalesce(1).write.parquet(f"{path}/book")
    coded = staged.filter("token IS NULL").select("doc_id", "ids")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = coded.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 and found else []
    (coded.mapInArrow(_code_batches(book, np.unique(np.array(marks, np.int64))), _CODED)
     .repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
     .mapInArrow(_block_batches, _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks"))
    return path


# --- reading -----------------------------------------------------------------------------------------------------

def read_book(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["token"], r["bits"]) for r in spark.read.parquet(f"{path}/book").collect())
    return tuple(np.array([r[k] for r in rows], np.int64) for k in (0, 1))


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each part; there are as many rows as parts."""
    starts, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r["part"]] = total
        total += r["n"]
    return starts


def block_ids(codes: CodeBook, row: dict) -> np.ndarray:
    lens = np.array(row["doc_lens"], np.int64)
    return codes.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u8").astype(np.int64), lane_starts(lens)[1])


def document_ids(codes: CodeBook, row: dict, nth: int, skip: int = 0) -> np.ndarray:
    """Ids of the ``nth`` document of a block from its id ``skip`` on, decoded from the checkpoint before it."""
    lens = np.array(row["doc_lens"], np.int64)
    lanes = (lens + CHECK_EVERY - 1) // CHECK_EVERY
    first = int(lanes[:nth].sum()) + skip // CHECK_EVERY
    last = int(lanes[: nth + 1].sum())
    checks = np.frombuffer(row["checkpoints"], "<u8").astype(np.int64)[first:last]
    return codes.decode(row["payload"], checks, lane_starts(lens)[1][first:last])[skip % CHECK_EVERY :]


def _read_batches(book, starts: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = CodeBook(*book)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = block_ids(codes, row).astype("<u4")
                lens = np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                raw, begins = memoryview(ids.tobytes()), (ends - lens).tolist()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts[row["part"]] + row["before"] + ends - lens),
                           pa.array(lens), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([*begins, int(ends[-1])], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, its ids."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(_read_batches(read_book(spark, path), part_starts(blocks), with_ids), schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, scratch_path(spark, "tokens")), with_ids=False)
