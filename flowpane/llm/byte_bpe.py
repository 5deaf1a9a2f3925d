"""Byte-level BPE encoding and decoding by recursive DuckDB queries over the distinct pieces of a task.

Every task cuts its texts into pieces by the public pattern and keeps the ids of pieces it has met. New pieces go through
one recursive query: rows (piece, position, token) join the merge table with their neighbour, and each piece's leftmost
pair of least rank is contracted until no pair merges. Decoding is an ordered aggregation of the tokens' bytes. DuckDB
runs inside the Python worker with one thread, bounded memory and no file.

Defined results: a null or empty text has no ids and decodes to no bytes; a null doc_id is kept; repeated rows give
repeated results; an empty table an empty one. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import GROUP_CHARS, SegmentTable, give_back, kept_in_worker, sums_by, text_groups, text_or_empty
from flowpane.llm.vocab import BYTE_BPE, byte_ranks

#: Longer pieces are merged by ``merge_long``: the recursive query takes a round per merge over the whole piece.
#: Positions must stay below 256, so that pair * 256 + pos orders pairs by rank, then from the left.
LONG_PIECE = 96
#: Pieces that go into one recursive query.
QUERY_PIECES = 10_000
#: Segments and pieces that a worker keeps for digests, and where only ids are wanted: other stages share its memory there, so it also
#: takes smaller groups of texts. Only time depends on them.
CACHED_SEGMENTS, CACHED_PIECES = 500_000, 600_000
ENCODED_SEGMENTS, ENCODED_PIECES, ENCODED_CHARS = 120_000, 200_000, GROUP_CHARS // 8

ENCODE = """
WITH RECURSIVE steps(piece, round, pos, npos, token, next, pair) AS (
    SELECT s.piece, 0, s.pos, s.pos + 1, s.token, s.next, m.rank
    FROM start s LEFT JOIN merges m ON m.a = s.token AND m.b = s.next
  UNION ALL
    SELECT k.piece, k.round, k.pos, k.npos, k.token, k.next, CASE WHEN k.changed THEN m.rank ELSE k.pair END
    FROM (
      SELECT s.piece, s.round + 1 AS round, s.pos,
             CASE WHEN s.pos = c.at THEN c.after_pos ELSE s.npos END AS npos,
             CASE WHEN s.pos = c.at THEN c.rank ELSE s.token END AS token,
             CASE WHEN s.pos = c.at THEN c.after WHEN s.npos = c.at THEN c.rank ELSE s.next END AS next,
             s.pair, s.pos = c.at OR s.npos = c.at AS changed
      FROM steps s JOIN (
        SELECT l.piece, l.rank, l.at, l.gone, r.npos AS after_pos, r.next AS after
        FROM (SELECT piece, min(pair) AS rank, arg_min(pos, pair * 256 + pos) AS at, arg_min(npos, pair * 256 + pos) AS gone
              FROM steps WHERE pair IS NOT NULL GROUP BY piece) l
        JOIN steps r ON r.piece = l.piece AND r.pos = l.gone) c ON s.piece = c.piece AND s.pos <> c.gone) k
    LEFT JOIN merges m ON m.a = CASE WHEN k.changed THEN k.token END AND m.b = k.next)
SELECT piece, pos, token FROM steps
JOIN (SELECT piece, max(round) AS round FROM steps GROUP BY piece) USING (piece, round) ORDER BY piece, pos
"""

DECODE = """
SELECT t.piece, string_agg(v.bytes, '' ORDER BY t.pos) AS bytes
FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.piece ORDER BY t.piece
"""


class Merges:
    """The rank of a pair of neighbours, read off the ranks of tokens: few pieces ask, so no table of all pairs is kept for them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}

    def get(self, pair: tuple[int, int]) -> int | None:
        return self.ranks.get(self.token[pair[0]] + self.token[pair[1]])


class BytePairs:
    """The merge table and the vocabulary of a rank file in a DuckDB of the worker's own."""

    def __init__(self, name: str = BYTE_BPE) -> None:
        import duckdb
        self.ranks = byte_ranks(name)
        self.base = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t))
                  if t[:k] in self.ranks and t[k:] in self.ranks]
        self.merge_of = Merges(self.ranks)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        a, b, rank = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._put("merges", pa.table({"a": a, "b": b, "rank": rank}))
        self._put("vocabulary", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.hex() for t in self.ranks]}))

    def _put(self, table: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {table} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, query: str, table: str, rows: pa.Table) -> dict[str, np.ndarray]:
        """The query over ``rows``, which it reads once where they are: tables made anew for every query were seen to leave memory."""
        self.db.register(table, rows)
        found = self.db.execute(query).fetchnumpy()
        self.db.unregister(table)
        return found

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of every piece, tokens): a piece that is a token stays whole, others are merged."""
        out: list = [None] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > LONG_PIECE:
                out[i] = merge_long(self.base[np.frombuffer(p, np.uint8)].tolist(), self.merge_of)
            else:
                short.append(i)
        for k in range(0, len(short), QUERY_PIECES):
            some = short[k : k + QUERY_PIECES]
            lens = np.fromiter((len(pieces[i]) for i in some), np.int64, len(some))
            flat = self.base[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
            ends = np.cumsum(lens)
            after = np.append(flat[1:], 0)
            last = np.zeros(len(flat), bool)
            last[ends - 1] = True
            rows = self._ask(ENCODE, "start", pa.table({
                "piece": np.repeat(np.arange(len(some), dtype=np.int32), lens),
                "pos": (np.arange(len(flat)) - np.repeat(ends - lens, lens)).astype(np.int32),
                "token": flat, "next": pa.array(after, pa.int32(), mask=last)}))
            cuts = np.searchsorted(rows["piece"], np.arange(len(some) + 1)).tolist()
            tokens = rows["token"].tolist()
            for j, i in enumerate(some):
                out[i] = tokens[cuts[j] : cuts[j + 1]]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        return lens, np.fromiter((t for x in out for t in x), np.int32, int(lens.sum()))

    def decode(self, lens: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """The bytes of consecutive runs of tokens."""
        ends = np.cumsum(lens)
        rows = self._ask(DECODE, "tokens", pa.table({"piece": np.repeat(np.arange(len(lens)), lens),
                                                     "pos": np.arange(len(tokens)) - np.repeat(ends - lens, lens), "token": tokens}))
        out = [b""] * len(lens)
        for i, text in zip(rows["piece"].tolist(), rows["bytes"].tolist(), strict=True):
            out[i] = bytes.fromhex(text)
        return out


def merge_long(tokens: list[int], merge_of: Merges) -> list[int]:
    """The same contraction, leftmost pair of least rank first, by a heap over a linked list: n log n for long pieces."""
    n = len(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := merge_of.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if tokens[i] >= 0 else n
        if j >= n or merge_of.get((tokens[i], tokens[j])) != rank:
            continue
        tokens[i], tokens[j] = rank, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := merge_of.get((rank, tokens[k]))) is not None:
                heapq.heappush(heap, (new, i))
        h = before[i]
        if h >= 0 and (new := merge_of.get((tokens[h], rank))) is not None:
            heapq.heappush(heap, (new, h))
    return [t for t in tokens if t >= 0]


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex
    return regex.compile(public_tokenizers.PATTERN), re.compile(r"[^\S \n]|[ \n](?:[ \n]|\Z)|\A[ \n]|\x00")


def segments(text: str) -> list[str]:
    """The text in stretches that the pattern cuts alike on their own: at single spaces and line breaks between words.

    A space goes with the word after it. Texts with other white space, or with runs of it, are cut by the pattern itself.
    """
    cut, odd = _pattern()
    if odd.search(text):
        return cut.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if text else []


class Pieces:
    """Segments with their tokens and, for digests, each one's ids as text and its decoded bytes."""

    def __init__(self, name: str = BYTE_BPE, digest: bool = False) -> None:
        self.pairs, self.digest = BytePairs(name), digest
        self.known: dict[str, tuple[bytes, bytes]] = {}  # ids as 32-bit numbers, decoded bytes
        self.most = CACHED_PIECES if digest else ENCODED_PIECES
        self.table = SegmentTable(self.values_of, np.int32, CACHED_SEGMENTS if digest else ENCODED_SEGMENTS)
        self.text: list[str] = []
        self.decoded: list[bytes] = []

    def values_of(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        dropped = len(new) == len(self.table.index)
        if dropped:
            self.text, self.decoded = [], []
        # ids alone: both go at once, since what is left of one would hold on to the pages of the other
        if len(self.known) > self.most or (dropped and not self.digest):
            self.known.clear()
        find = _pattern()[0].findall
        cut = list(map(find, new))
        todo = list({p for x in cut for p in x if p not in self.known})
        raw = [p.encode() for p in todo]
        lens, tokens = self.pairs.encode(raw)
        decoded = self.pairs.decode(lens, tokens)
        if not self.digest:
            if decoded != raw:  # a text is its pieces one after another
                raise ValueError("ids that do not give the text back")
            decoded = [b""] * len(lens)
        flat, at = tokens.astype(np.int32).tobytes(), 0
        for p, n, back in zip(todo, lens.tolist(), decoded, strict=True):
            self.known[p] = (flat[at : at + 4 * n], back)
            at += 4 * n
        known, ids = self.known, []
        for x in cut:
            if len(x) == 1:
                own, back = known[x[0]]
            else:
                own, back = b"".join([known[p][0] for p in x]), b"".join([known[p][1] for p in x])
            ids.append(own)
            if self.digest:
                self.decoded.append(back)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values = np.frombuffer(b"".join(ids), np.int32)
        if self.digest:
            numbers, at = values.tolist(), 0
            for n in lens.tolist():
                self.text.append(",".join(map(str, numbers[at : at + n])))
                at += n
        return lens, values


def pieces_of(tokenizer: str, digest: bool = False) -> Pieces:
    """The worker's table of pieces, kept between tasks."""
    return kept_in_worker(("pieces", tokenizer, digest), lambda: Pieces(tokenizer, digest))


def _encode_batches(tokenizer: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(tokenizer, digest)
        for batch in batches:
            for start, texts in text_groups(batch.column(1), GROUP_CHARS if digest else ENCODED_CHARS):
                at, counts = pieces.table.numbers(list(map(segments, texts)))
                if not digest:
                    give_back()
                ids, lens = pieces.table.ragged, pieces.table.ragged.lens(at)
                ends = np.cumsum(counts)
                if not digest:
                    cuts = np.concatenate([[0], np.cumsum(sums_by(counts, lens))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)),
                                                      pa.ListArray.from_arrays(cuts, pa.array(ids.take(at)))], names=["doc_id", "ids"])
                    continue
                rows, numbers = [], at.tolist()
                for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    own = numbers[a:b]
                    rows.append({"n_tokens": int(lens[a:b].sum()),
                                 "ids_sha256": hashlib.sha256(",".join([pieces.text[i] for i in own]).encode()).hexdigest(),
                                 "decoded_sha256": hashlib.sha256(b"".join([pieces.decoded[i] for i in own])).hexdigest()})
                out = pa.RecordBatch.from_pylist(rows, pa.schema(
                    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *out.columns], names=["doc_id", *out.schema.names])
    return run


def _decode_batches(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pieces_of(tokenizer).pairs
        for batch in batches:
            for k in range(0, len(batch), 500):
                some = batch.slice(k, 500)
                ids = [x or [] for x in some.column(1).to_pylist()]
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                back = pairs.decode(lens, np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum())))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(back, pa.binary())], names=["doc_id", "bytes"])
    return run


def encode(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids) of every text; every distinct piece's ids are decoded again and compared with it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_encode_batches(tokenizer, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, bytes) of every row of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches(tokenizer), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_encode_batches(tokenizer, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
