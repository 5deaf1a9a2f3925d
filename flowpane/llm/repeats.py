"""Exact removal of repeated passages by sorted suffixes: front-coded runs, exchanged and merged by loser trees.

A byte goes if a ``LENGTH``-byte string over it also starts anywhere else. Suffixes are taken at anchors only: the anchor of a
window is the leftmost least-hashed gram among its first ``SPAN``, so equal windows have equal anchors at equal offsets. What
stands around an anchor (its suffix, then what precedes it, backwards) decides all windows that have it.

1. Anchors whose next ``LENGTH - SPAN + 1`` bytes occur once have no repeated window; a count of hashes leaves the others.
2. Every task sorts the contexts of its anchors into runs, collapses equal ones, and writes the runs front-coded.
3. The runs are cut at sampled splitters and exchanged. A loser tree merges the runs of a range; it knows the common prefix of
   every head with the last output, so no known prefix is compared again, and puts out the common prefix of neighbours.
4. Equal contexts have all windows repeated. Of different ones, neighbours' common prefixes leave the windows that may be
   repeated; those are compared by 128-bit hashes within the task, which settles all that stand twice there. Where a neighbourhood
   reaches over a splitter, its other windows, and one row for each different settled one, go to a grouped count over all ranges.

Defined results: a null text counts as empty; a null doc_id is kept; rows that repeat a document repeat its windows, and so lose
them; texts under ``LENGTH`` bytes lose nothing; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import stage, text_groups, text_or_empty

LENGTH, SPAN, GRAM = 400, 200, 24
COMMON = LENGTH - SPAN + 1
#: Bytes of contexts that a run holds, and contexts of a front-coded row.
RUN_BYTES, ROW_CONTEXTS = 24_000_000, 64
#: Front-coded rows of a range of sorted contexts; fewer ranges part fewer neighbourhoods.
RANGE_ROWS = 1_000
#: Contexts of a neighbourhood that are compared at once.
GROUP_CONTEXTS = 8_192
#: Sampled keys per range.
OVERSAMPLING = 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, (2, 256)).astype(np.uint64)
_BASE = [int(x) | 1 for x in _RNG.integers(1 << 40, 1 << 62, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2 ** 64, and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        base = _BASE[which]
        with np.errstate(over="ignore"):
            _POWERS[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 12), b, np.uint64)]), dtype=np.uint64)
                                   for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[which]


def _prefixes(data: np.ndarray, which: int = 0) -> np.ndarray:
    up = _powers(which, len(data))[0]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][data] * up[: len(data)], dtype=np.uint64)])


def _hashes(prefix: np.ndarray, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of the ``n`` bytes from each of ``at`` on."""
    x = (prefix[at + n] - prefix[at]) * _powers(which, len(prefix))[1][at]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, least offset, greatest offset, hash of what follows) of all windows of texts that lie one after another."""
    n = len(data) - GRAM + 1
    if n < SPAN:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = _prefixes(data)
    at = np.arange(n, dtype=np.uint64)
    least = _hashes(prefix, np.arange(n), GRAM) >> np.uint64(32) << np.uint64(32) | at
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - SPAN + 1], least[SPAN - width : SPAN - width + n - SPAN + 1])
    sizes = np.maximum(ends - starts - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(starts)), sizes)
    s = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(first[1:], len(s)) - 1
    a = p[first]
    return doc[first], a - starts[doc[first]], a - s[last], a - s[first], _hashes(prefix, a, COMMON).view(np.int64)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
        for start, texts in text_groups(batch.column(2), 1_000_000):
            raw = [t.encode() for t in texts]
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            starts = np.concatenate([[0], ends[:-1]])
            doc, pos, low, high, h = anchors(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[start + doc], k2[start + doc], h)]
                                             + [pa.array(x, pa.int32()) for x in (pos, low, high)], names=["k1", "k2", "h", "pos", "low", "high"])


# --- runs ---------------------------------------------------------------------------------------------------------

_RESULT = "k1 long, k2 long, pos int, low int, high int"


def context(raw: bytes, pos: int, low: int, high: int) -> bytes:
    """Suffix, reversed left side and their extents; equal for anchors whose windows are all equal."""
    return raw[pos : pos + LENGTH - low] + raw[pos - high : pos][::-1] + low.to_bytes(2, "big") + high.to_bytes(2, "big")


def common_prefix(a: bytes, b: bytes, k: int = 0) -> int:
    """Length of the common prefix, known to be ``k`` at least."""
    n = min(len(a), len(b))
    step = 32
    while k < n and a[k : k + step] == b[k : k + step]:
        k = min(k + step, n)
    end = min(k + step, n)
    while k < end and a[k] == b[k]:
        k += 1
    return k


def front_coded(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    lcps = [0, *[common_prefix(a, b) for a, b in zip(keys, keys[1:])]]
    return lcps, [k[c:] for k, c in zip(keys, lcps, strict=True)]


_RUN = pa.schema([("run", pa.int64()), ("seq", pa.int32()), ("first", pa.binary()), ("lcp", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())),
                  ("times", pa.list_(pa.int32())), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())),
                  ("target", pa.int32())])
_RUN_DDL = ("run long, seq int, first binary, lcp array<int>, rest array<binary>, times array<int>, k1 array<long>, k2 array<long>, pos array<int>, target int")


def _run_rows(items: list[tuple[bytes, int, int, int, int]], run: int, seq: int, target: int | None) -> list[dict]:
    """Front-coded rows of sorted (context, times, k1, k2, pos)."""
    rows = []
    for at in range(0, len(items), ROW_CONTEXTS):
        some = items[at : at + ROW_CONTEXTS]
        lcps, rest = front_coded([x[0] for x in some])
        rows.append({"run": run, "seq": seq + at // ROW_CONTEXTS, "first": some[0][0] if target is None else None, "lcp": lcps, "rest": rest,
                     "times": [x[1] for x in some], "k1": [x[2] for x in some], "k2": [x[3] for x in some], "pos": [x[4] for x in some], "target": target})
    return rows


def _unpacked(row: dict) -> list[tuple[bytes, int, int, int, int]]:
    out, last = [], b""
    for lcp, rest, *other in zip(row["lcp"], row["rest"], row["times"], row["k1"], row["k2"], row["pos"], strict=True):
        last = last[:lcp] + rest
        out.append((last, *other))
    return out


def _sorted_run(held: list[tuple[bytes, int, int, int]], run: int) -> Iterator[pa.RecordBatch]:
    """The run of the contexts; those that occur twice in it are decided, and one of them goes on for comparison."""
    held.sort()
    items, decided = [], []
    for key, same in groupby(held, key=lambda x: x[0]):
        same = list(same)
        items.append((key, min(2, len(same)), *same[0][1:]))
        if len(same) > 1:
            decided += [{"k1": [k1], "k2": [k2], "pos": [pos], "lcp": [int.from_bytes(key[-4:-2], "big"), int.from_bytes(key[-2:], "big")]}
                        for _, k1, k2, pos in same]
    for at in range(0, len(items), 4096):
        yield pa.RecordBatch.from_pylist(_run_rows(items[at : at + 4096], run, at // ROW_CONTEXTS, None), schema=_RUN)
    for at in range(0, len(decided), 4096):
        yield pa.RecordBatch.from_pylist(decided[at : at + 4096], schema=_RUN)


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    run = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), 64):
            for row in batch.slice(at, 64).to_pylist():
                raw = row["text"].encode()
                for a in row["marks"]:
                    key = context(raw, a["pos"], a["low"], a["high"])
                    held.append((key, row["k1"], row["k2"], a["pos"]))
                    size += len(key) + 100
                    if size >= RUN_BYTES:
                        yield from _sorted_run(held, run)
                        run, held, size = run + 1, [], 0
    yield from _sorted_run(held, run)


def _cut_batches(splitters: list[bytes]):
    """Rows of runs cut at the splitters, with the range they go to."""
    from bisect import bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    items = _unpacked(row)
                    for target, some in groupby(items, key=lambda x: bisect_right(splitters, x[0])):
                        rows += _run_rows(list(some), row["run"], row["seq"], target)
                yield pa.RecordBatch.from_pylist(rows, schema=_RUN)
    return run


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, item); puts out (common prefix with the last output, item)."""

    def __init__(self, runs: list[Iterator[tuple[int, tuple]]]) -> None:
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers: list = [None] * self.size
        heads = [self._head(i) if i < len(runs) else None for i in range(self.size)]
        level = [(h and [0, h[1], i]) for i, h in enumerate(heads)]
        node = self.size
        while len(level) > 1:
            node //= 2
            up = []
            for k in range(0, len(level), 2):
                winner, self.losers[node + k // 2] = self._play(level[k], level[k + 1])
                up.append(winner)
            level = up
        self.winner = level[0] if level else None

    def _head(self, run: int):
        return next(self.runs[run], None)

    @staticmethod
    def _play(a, b):
        """(winner, loser). Both know their common prefix with the last output; the loser then knows it with the winner."""
        if a is None or b is None:
            return (a, b) if b is None else (b, a)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y = a[1][0], b[1][0]
        k = common_prefix(x, y, a[0])
        if k == len(x) or k < len(y) and x[k] < y[k]:
            b[0] = k
            return a, b
        a[0] = k
        return b, a

    def __iter__(self):
        while self.winner is not None:
            lcp, item, run = self.winner
            yield lcp, item
            head = self._head(run)
            player = head and [head[0], head[1], run]
            node = (self.size + run) // 2
            while node:
                player, self.losers[node] = self._play(player, self.losers[node])
                node //= 2
            self.winner = player


def _coded_items(rows: list[dict]) -> Iterator[tuple[int, tuple]]:
    last = b""
    for row in rows:
        for k, item in enumerate(_unpacked(row)):
            yield (row["lcp"][k] if k else common_prefix(last, item[0])), item
            last = item[0]


def _extent(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[-4:-2], "big"), int.from_bytes(key[-2:], "big")


def window_hashes(key: bytes, low: int, high: int) -> np.ndarray:
    """128-bit hashes of the context's windows at offsets low..high, as rows of two numbers."""
    own_low, own_high = _extent(key)
    right = LENGTH - own_low
    data = np.frombuffer(key[right : right + own_high][::-1] + key[:right], np.uint8)
    at = own_high - np.arange(low, high + 1)
    return np.stack([_hashes(_prefixes(data, w), at, LENGTH, w).view(np.int64) for w in (0, 1)], axis=1)


_MERGED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("high", pa.int32()),
                     ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())), ("times", pa.int32())])
_MERGED_DDL = _RESULT + ", w1 array<long>, w2 array<long>, times int"


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist(), strict=True))


def _judged(group: list, whole: bool) -> Iterator[dict]:
    """Results of neighbours [context, times, members, greatest common prefix]; ``whole``: none lies in another range."""
    ranges = []
    for key, times, _, most in group:
        low, high = _extent(key)
        low = max(low, LENGTH - most)
        ranges.append((low, high) if low <= high else None)
    # decided contexts count for those that another range holds
    if whole and (len(group) < 2 or not any(r and g[1] < 2 for r, g in zip(ranges, group, strict=True))):
        return
    hashes = [window_hashes(g[0], *r) if r else np.zeros((0, 2), np.int64) for r, g in zip(ranges, group, strict=True)]
    every = np.concatenate(hashes)
    times = np.repeat([g[1] for g in group], [len(h) for h in hashes])
    _, first, inverse = np.unique(every, axis=0, return_index=True, return_inverse=True)
    twice, at = (np.bincount(inverse.ravel(), times, len(first)) > 1)[inverse.ravel()], 0
    for r, g, h in zip(ranges, group, hashes, strict=True):
        if g[1] < 2:
            k1, k2, pos = g[2][0]
            settled = twice[at : at + len(h)]
            for a, b in stretches(settled):
                yield {"k1": k1, "k2": k2, "pos": pos, "low": r[0] + a, "high": r[0] + b}
            for a, b in stretches(~settled) if not whole else ():
                yield {"k1": k1, "k2": k2, "pos": pos, "low": r[0] + a, "high": r[0] + b, "w1": h[a : b + 1, 0].tolist(),
                       "w2": h[a : b + 1, 1].tolist(), "times": 1}
        at += len(h)
    if not whole:
        # what stands twice here is one row for each different window, whatever the number of its members
        for some in np.array_split(first[twice[first]], max(1, len(first) // 2000)):
            if len(some):
                yield {"k1": None, "k2": None, "pos": None, "low": 0, "high": 0, "w1": every[some, 0].tolist(), "w2": every[some, 1].tolist(), "times": 2}


def _merge_range(rows: list[dict]) -> Iterator[dict]:
    rows.sort(key=lambda r: (r["run"], r["seq"]))
    runs = [_coded_items(list(own)) for _, own in groupby(rows, key=lambda r: r["run"])]
    group: list = []
    at_edge = True

    def one(key, times, members):
        if times > 1:  # members of a run's own pairs are decided there
            low, high = _extent(key)
            for k1, k2, pos in members:
                yield {"k1": k1, "k2": k2, "pos": pos, "low": low, "high": high}

    last = None
    for lcp, (key, times, k1, k2, pos) in LoserTree(runs):
        member = [(k1, k2, pos)] if times < 2 else []
        if last is not None and lcp == len(key) == len(last[0]):
            last[1] += times
            last[2] += member
            continue
        if last is not None:
            yield from one(*last[:3])
            last[3] = max(last[3], lcp)
        if last is None or lcp < COMMON or len(group) >= GROUP_CONTEXTS:
            parted = last is not None and lcp >= COMMON  # a large neighbourhood is parted as if by a splitter
            if group:
                yield from _judged(group, not at_edge and not parted)
                at_edge = parted
            group = []
        last = [key, times, member, lcp if last is not None else LENGTH]
        group.append(last)
    if last is not None:
        yield from one(*last[:3])
        last[3] = LENGTH
        yield from _judged(group, False)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed(rows):
        out = []
        for x in _merge_range(rows):
            out.append(x)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=_MERGED)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=_MERGED)
    target, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["target"] != target:
                yield from flushed(held)
                held = []
            target = row["target"]
            held.append(row)
    if held:
        yield from flushed(held)


# --- the job ------------------------------------------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(text, doc, F.lit(1)).alias("k2"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans): for every text with repeated windows, the byte spans [a, b) that they cover."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    found = stage(keyed.filter(F.octet_length("text") >= LENGTH).select("k1", "k2", "text").mapInArrow(
        _anchor_batches, "k1 long, k2 long, h long, pos int, low int, high int"), "anchors")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    marks = found.join(again, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "low", "high")).alias("marks"))
    runs = stage(keyed.select("k1", "k2", "text").join(marks, ["k1", "k2"]).select("k1", "k2", "text", "marks").mapInArrow(_run_batches, _RUN_DDL), "runs")
    coded = runs.filter("run IS NOT NULL")
    decided = runs.filter("run IS NULL").select(F.col("k1")[0].alias("k1"), F.col("k2")[0].alias("k2"), F.col("pos")[0].alias("pos"),
                                                F.col("lcp")[0].alias("low"), F.col("lcp")[1].alias("high"))
    n = coded.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    # about OVERSAMPLING keys per range come to the driver
    rate = min(1.0, OVERSAMPLING * parts / max(n, 1))
    sample = sorted(bytes(r["first"]) for r in coded.filter(F.pmod(F.xxhash64("run", "seq"), F.lit(1_000_000)) < int(1_000_000 * rate)).select("first").collect())
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    merged = stage(coded.mapInArrow(_cut_batches(splitters), _RUN_DDL).repartition(parts, "target").sortWithinPartitions("target", "run", "seq")
                   .mapInArrow(_merge_batches, _MERGED_DDL), "merged")
    sure = merged.filter("w1 IS NULL").select("k1", "k2", "pos", "low", "high")
    open_ = merged.filter("w1 IS NOT NULL").select("k1", "k2", "pos", "times", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"), "low").select(
        "k1", "k2", "pos", "times", (F.col("low") + F.col("i")).alias("low"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    often = open_.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").select("w1", "w2")
    shared = open_.filter("pos IS NOT NULL").join(often, ["w1", "w2"]).select("k1", "k2", "pos", "low", F.col("low").alias("high"))
    span = F.struct((F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("low") + LENGTH).alias("b"))
    return decided.union(sure).union(shared).groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _clean_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    raw, spans = row["text"].encode(), _joined(row["spans"] or [])
                    kept, start = [], 0
                    for a, b in spans:
                        kept.append(raw[start:a])
                        start = b
                    left = b"".join([*kept, raw[start:]])
                    rows.append({"doc_id": row["doc_id"], "n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(spans),
                                 "kept_sha256": hashlib.sha256(left).hexdigest(), "has_repeat": bool(spans)} | ({"kept": left} if with_text else {}))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                     ("has_repeat", pa.bool_())]
                    + [("kept", pa.binary())] * with_text))
    return run


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, kept_sha256, whether it has a repeat and, if asked for, the bytes that stay."""
    rows = _keyed(docs).join(repeated_spans(docs), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_clean_batches(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeat boolean" + ", kept binary" * with_text)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
