"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

1. Documents are dealt into blocks of bounded size. A block numbers its words, counts its n-grams in training documents, and asks
   for the global counts of all its n-grams: one row per block and range of hashes, so a very frequent n-gram is one entry a block.
2. The counts of a range are summed and go back to the blocks that asked, in the order in which they asked.
3. A block's part of the model becomes an automaton. Its states are the n-grams below the highest order that occur in training,
   with an arc for every next word seen after them, and a failure arc, weighted by what is left to unseen words, to the state
   of the n-gram without its first word. As a block asked for every n-gram that it holds, no arc that its documents can take is missing.
4. One left-to-right traversal per document carries a state, falls along failure arcs until an arc fits, and adds up weights.
   Documents of a block advance together; a long one is cut where a state is determined by the words just before.

The model: P(w | h) = a c(hw) / c(h) + (1 - a) P(w | h without its first word); a depends on the order and on the power of two of
c(h), and is the one that fits best when every training token is predicted from all others (a table of at most 64 x 320 counts
per order). At the end stands P(w) = (1 - u) c(w) / N for known words; unknown words, as one class, have u, the share of
words that occur once, so the V + 1 events sum to one. Counts are of all training documents and live in written tables only.

Defined results: a null or empty text is its end token alone; a null doc_id counts as an empty string for the split; rows that
repeat a document are counted and scored each; without training documents every score is 0; an empty table gives an empty
result. Only doc_id and text are read. Words are told apart by 96-bit hashes, longer n-grams by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import Interned, release, scratch_path, stage, text_groups, text_or_empty
from flowpane.llm.packing import pack, unpack

ORDER = 2
FOLDS, HELD = 7, 2
#: Bytes of text in a block (a longer text is a block of its own) and, about, behind a range of hashes.
BLOCK_BYTES, RANGE_BYTES = 16_000_000, 16_000_000
#: Words of a document that one lane of the traversal reads.
LANE_WORDS = 256
LEAST_SHARE, MOST_SHARE, USUAL_SHARE = 1e-4, 0.98, 0.1
_END = b""  # no word is empty
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_ZERO_RATIO, _RATIO_STEPS, _MOST_RATIO = 0, 4, 159

_CELL = "block long, level int, range int, n int, keys binary, counts binary"
_DOCS = "doc_ids array<long>, train array<boolean>, lens array<int>, ids binary, by_use binary, hashes binary"


# --- n-grams of a block ---------------------------------------------------------------------------------------------

def _mixed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram from those of all but its last word and of its last word."""
    with np.errstate(over="ignore"):
        x = prefix * _GOLDEN + (word ^ _MIX2)
        x = (x ^ x >> np.uint64(30)) * _MIX1
        x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


class Grams:
    """The n-grams of a block, level by level. ``ids`` holds the documents one after another, each as end, words, end.

    A level has ``codes``, sorted: the index of an n-gram without its last word on the level below, times the number of words,
    plus the last word. ``at`` has the index of the n-gram that ends at every position, -1 where the document is too short.
    """

    def __init__(self, ids: np.ndarray, lens: np.ndarray, n_words: int, order: int) -> None:
        self.n_words = n_words
        first = np.cumsum(lens) - lens
        place = np.arange(len(ids)) - np.repeat(first, lens)
        self.codes, self.at = [np.arange(n_words)], [np.where(place > 0, ids, -1)]
        below = ids.astype(np.int64)
        for level in range(2, order + 1):
            inside = np.flatnonzero(place >= level - 1)
            codes, at = np.unique(below[inside - 1] * n_words + ids[inside], return_inverse=True)
            below = np.full(len(ids), -1)
            below[inside] = at
            self.codes.append(codes)
            self.at.append(below)

    def counts(self, level: int, weight: np.ndarray) -> np.ndarray:
        """Occurrences of a level's n-grams, positions weighted."""
        at = self.at[level]
        return np.bincount(at[at >= 0], weight[at >= 0], len(self.codes[level])).astype(np.int64)

    def hashes(self, words: np.ndarray) -> list[np.ndarray]:
        out = [words]
        for codes in self.codes[1:]:
            out.append(_mixed(out[-1][codes // self.n_words], words[codes % self.n_words]))
        return out


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of hashes begin in sorted keys."""
    starts = [(i << 64) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(starts, np.uint64)), [len(keys)]]).astype(np.int64)


def _pack_keys(keys: np.ndarray, low: np.ndarray | None) -> bytes:
    """Sorted 64-bit keys as differences; of words also 32 bits from the lower halves of their hashes."""
    return int(keys[0]).to_bytes(8, "little") + (low.astype("<u4").tobytes() if low is not None else b"") + pack(np.diff(keys))


def _unpack_keys(raw: bytes, n: int, words: bool) -> tuple[np.ndarray, np.ndarray | None]:
    low = np.frombuffer(raw, "<u4", n, 8) if words else None
    keys = np.empty(n, np.uint64)
    keys[0] = int.from_bytes(raw[:8], "little")
    keys[1:] = unpack(raw[8 + 4 * n * words :], n - 1)
    return np.cumsum(keys, dtype=np.uint64), low


def _pack_ids(ids: np.ndarray, n_words: int) -> tuple[bytes, bytes]:
    """Word numbers, compressed as places among the words by falling use, and the words in that order."""
    import zstandard
    by_use = np.argsort(-np.bincount(ids, minlength=n_words), kind="stable")
    place = np.empty(n_words, np.int64)
    place[by_use] = np.arange(n_words)
    return zstandard.compress(pack(place[ids])), pack(by_use)


def _unpack_ids(raw: bytes, by_use: bytes, n: int, n_words: int) -> np.ndarray:
    import zstandard
    return unpack(by_use, n_words).astype(np.int64)[unpack(zstandard.decompress(raw), n)]


class _Block:
    """Documents gathered for a block, their words numbered as they come."""

    def __init__(self) -> None:
        self.words, self.ids, self.lens, self.doc_ids, self.train, self.size = Interned(), [], [], [], [], 0
        self.words[_END]

    def add(self, doc_id, train: bool, text: str) -> None:
        raw = text.encode().lower().split()  # of bytes: only A-Z change, only space and \\t-\\r separate
        self.ids.append(np.array([0, *map(self.words.__getitem__, raw), 0], np.int32))
        self.lens.append(len(raw) + 2)
        self.doc_ids.append(doc_id)
        self.train.append(train)
        self.size += len(text)

    def rows(self, block: int, order: int, ranges: int) -> Iterator[tuple]:
        """The block's documents with words renumbered in the order of their hashes, then what it asks each range for."""
        import xxhash
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), ">u8").reshape(-1, 2).astype(np.uint64)
        by_hash = np.lexsort((digests[:, 1], digests[:, 0]))
        rank = np.empty(len(by_hash), np.int32)
        rank[by_hash] = np.arange(len(by_hash), dtype=np.int32)
        digests = digests[by_hash]
        ids, lens = rank[np.concatenate(self.ids)], np.array(self.lens, np.int64)
        yield (block, 0, 0, len(digests), None, None, self.doc_ids, self.train, lens.astype(np.int32), *_pack_ids(ids, len(digests)),
               _pack_keys(digests[:, 0], None))
        grams = Grams(ids, lens, len(digests), order)
        weight = np.repeat(np.array(self.train, np.float64), lens)
        for level, keys in enumerate(grams.hashes(digests[:, 0])):
            counts, low = grams.counts(level, weight), digests[:, 1]
            if level:
                order_ = np.argsort(keys, kind="stable")
                keys, counts, low = keys[order_], counts[order_], None
            cuts = _bounds(keys, ranges)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                yield (block, level + 1, r, int(b - a), _pack_keys(keys[a:b], None if low is None else low[a:b]), pack(counts[a:b]),
                       *[None] * 6)


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()),
          pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["block", "level", "range", "n", "keys", "counts", "doc_ids", "train", "lens", "ids", "by_use", "hashes"]


def _ask(order: int, ranges: int, block_bytes: int):
    def written(block: _Block, number: int) -> Iterator[pa.RecordBatch]:
        for row in block.rows(number, order, ranges):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for start, texts in text_groups(batch.column(1)):
                ids, train = (batch.column(i).slice(start, len(texts)).to_pylist() for i in (0, 2))
                for doc_id, text, trains in zip(ids, texts, train, strict=True):
                    if block.size and block.size + len(text) > block_bytes:
                        yield from written(block, number)
                        block, number = _Block(), number + 1
                    block.add(doc_id, trains, text)
        if block.lens:
            yield from written(block, number)
    return run


# --- global counts --------------------------------------------------------------------------------------------------

_REPLY = "block long, level int, range int, n int, counts binary, words long, once long, tokens long"


def _sum_range(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of a range of hashes, for every block in the order in which it asked; the first row has what the words sum to."""
    level = key[0].as_py()
    rows = table.select(["block", "n", "keys", "counts"]).to_pylist()
    keys, low = zip(*(_unpack_keys(r["keys"], r["n"], level == 1) for r in rows), strict=True)
    counts = np.concatenate([unpack(r["counts"], r["n"]) for r in rows])
    keys = np.concatenate(keys)
    if level == 1:
        low = np.concatenate(low)
        order = np.lexsort((low, keys))
        new = np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(low[order]) != 0)])
    else:
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], np.diff(keys[order]) != 0])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    totals = np.bincount(at, counts).astype(np.uint64)
    cuts = np.cumsum([0] + [r["n"] for r in rows])
    replies = [pack(totals[at[a:b]]) for a, b in zip(cuts, cuts[1:])]
    facts = [[int((totals > 0).sum()), int((totals == 1).sum()), int(totals.sum())]] if level == 1 else [[0, 0, 0]]
    words, once, tokens = zip(*(facts + [[0, 0, 0]] * (len(rows) - 1)), strict=True)
    n = len(rows)
    return pa.table({"block": [r["block"] for r in rows], "level": pa.array([level] * n, pa.int32()), "range": pa.array([key[1].as_py()] * n, pa.int32()),
                     "n": pa.array([r["n"] for r in rows], pa.int32()), "counts": pa.array(replies, pa.binary()),
                     "words": list(words), "once": list(once), "tokens": list(tokens)})


class Facts:
    """What all blocks share: training tokens, different words in them, words that occur once, order of the model."""

    def __init__(self, tokens: int, words: int, once: int, order: int) -> None:
        self.tokens, self.words, self.order = tokens, words, order
        self.unknown = (once + 1) / (tokens + 2) if tokens else 1.0


# --- automaton ------------------------------------------------------------------------------------------------------

def _power(counts: np.ndarray) -> np.ndarray:
    """The power of two below every count (0 for counts below 2)."""
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


class Automaton:
    """States, arcs and failure arcs of a block's part of the model; ``counts`` per level are those of all training documents.

    ``shares`` has, per level from 2 on, the share of the level's own estimate by the power of two of the context's count.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], facts: Facts, shares: list[np.ndarray]) -> None:
        self.grams, self.counts, self.facts, self.n_words = grams, counts, facts, grams.n_words
        self.shorter: list[np.ndarray] = [np.zeros(0, np.int64)]  # index of an n-gram without its first word, a level below
        for level in range(1, facts.order):
            codes = grams.codes[level]
            before, last = codes // self.n_words, codes % self.n_words
            self.shorter.append(last if level == 1 else np.searchsorted(grams.codes[level - 1], self.shorter[-1][before] * self.n_words + last))
        self.arcs, self.failures = self._weigh(shares)

    def _weigh(self, shares: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        chance = np.where(self.counts[0] > 0, (1 - self.facts.unknown) * self.counts[0] / max(self.facts.tokens, 1), self.facts.unknown)
        arcs, failures = [np.log10(chance)], []
        for level in range(1, self.facts.order):
            context = self.counts[level - 1]
            share = shares[level - 1][_power(context)]
            failures.append(np.log10(1 - share))
            before = self.grams.codes[level] // self.n_words
            own = self.counts[level] / np.maximum(context[before], 1)
            chance = share[before] * own + (1 - share[before]) * chance[self.shorter[level]]
            arcs.append(np.log10(chance))
        return arcs, failures

    def step(self, level: np.ndarray, at: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        """Read one word in every lane: states (level of the n-gram, 0 for none; its index) and weights change in place."""
        todo = level.copy()
        for k in range(self.facts.order - 1, 0, -1):
            lanes = np.flatnonzero(todo == k)
            if not len(lanes):
                continue
            codes = self.grams.codes[k]
            code = at[lanes] * self.n_words + word[lanes]
            to = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            fits = (codes[to] == code) & (self.counts[k][to] > 0)
            hit, to = lanes[fits], to[fits]
            weight[hit] += self.arcs[k][to]
            level[hit], at[hit] = (k + 1, to) if k + 1 < self.facts.order else (k, self.shorter[k][to])
            todo[hit] = -1
            fall = lanes[~fits]
            weight[fall] += self.failures[k - 1][at[fall]]
            todo[fall] = k - 1
            if k > 1:
                at[fall] = self.shorter[k - 1][at[fall]]
        lanes = np.flatnonzero(todo == 0)
        weight[lanes] += self.arcs[0][word[lanes]]
        known = self.counts[0][word[lanes]] > 0
        level[lanes], at[lanes] = np.where(known & (self.facts.order > 1), 1, 0), word[lanes]

    def traverse(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log10 probability of every document."""
        order = self.facts.order
        sizes = lens - 1
        n_lanes = -(-sizes // LANE_WORDS)
        doc = np.repeat(np.arange(len(lens)), n_lanes)
        skip = LANE_WORDS * (np.arange(len(doc)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes))
        first = (np.cumsum(lens) - lens)[doc]
        long = np.minimum(LANE_WORDS, sizes[doc] - skip)
        by_size = np.argsort(-long, kind="stable")
        doc, skip, first, long = doc[by_size], skip[by_size], first[by_size], long[by_size]
        level, at, weight = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for back in range(order - 1, -1, -1):  # the words just before a lane determine its state; a document starts at its end token
            begins = skip == back
            level[begins], at[begins] = (1 if order > 1 and self.counts[0][ids[0]] > 0 else 0), ids[0]
            run = np.flatnonzero(skip >= back) if back else np.zeros(0, np.int64)
            if len(run):
                a, b, w = level[run], at[run], np.zeros(len(run))
                self.step(a, b, ids[first[run] + skip[run] - back + 1], w)
                level[run], at[run] = a, b
        active = np.searchsorted(-long, -np.arange(LANE_WORDS), side="left")
        for i in range(int(long.max(initial=0))):
            n = active[i]
            self.step(level[:n], at[:n], ids[first[:n] + skip[:n] + i + 1], weight[:n])
        return np.bincount(doc, weight, len(lens))

    def evidence(self, level: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the level's estimate is how many times the one below, when each training token is predicted from the others:
        (power of the context's count, step of the ratio) as one number, and occurrences."""
        grams, n_words = self.grams, self.n_words
        times = grams.counts(level, weight)
        codes, c = grams.codes[level], self.counts
        context, below = c[level - 1][codes // n_words], self.shorter[level]
        used = np.flatnonzero((times > 0) & (context > 1))
        own = (c[level][used] - 1) / (context[used] - 1)
        ratio = own / self._left_out(level - 1, below[used])
        steps = np.clip(np.rint(_RATIO_STEPS * np.log2(np.maximum(ratio, 1e-300))), -_MOST_RATIO, _MOST_RATIO).astype(np.int64) + _MOST_RATIO + 1
        steps[own == 0] = _ZERO_RATIO
        keys, inverse = np.unique(_power(context[used] - 1) * 512 + steps, return_inverse=True)
        return keys, np.bincount(inverse, times[used], len(keys)).astype(np.int64)

    def _left_out(self, level: int, at: np.ndarray) -> np.ndarray:
        """Probability of n-grams' last words with one occurrence left out; levels between weigh one half."""
        c = self.counts[level][at]
        if level == 0:
            return np.where(c > 1, (1 - self.facts.unknown) * (c - 1) / max(self.facts.tokens - 1, 1), self.facts.unknown)
        context = self.counts[level - 1][self.grams.codes[level][at] // self.n_words]
        return 0.5 * (c - 1) / np.maximum(context - 1, 1) + 0.5 * self._left_out(level - 1, self.shorter[level][at])


def fit_shares(evidence: dict[tuple[int, int, int], int], order: int) -> list[np.ndarray]:
    """Per level from 2 on and power of the context's count, the share under which left-out tokens are likeliest."""
    out = []
    for level in range(2, order + 1):
        shares, last = np.empty(64), USUAL_SHARE
        for power in range(64):
            found = [(s, n) for (k, p, s), n in evidence.items() if k == level and p == power]
            if found:
                steps, n = (np.array(x) for x in zip(*sorted(found), strict=True))
                gain = np.where(steps == _ZERO_RATIO, 0.0, 2.0 ** ((steps - _MOST_RATIO - 1) / _RATIO_STEPS)) - 1
                a, b = LEAST_SHARE, MOST_SHARE
                for _ in range(50):
                    mid = (a + b) / 2
                    a, b = (mid, b) if (n * gain / (1 + mid * gain)).sum() > 0 else (a, mid)
                last = (a + b) / 2
            shares[power] = last
        out.append(shares)
    return out


# --- whole jobs -----------------------------------------------------------------------------------------------------

_MODEL = ("doc_ids array<long>, train array<boolean>, lens array<int>, ids binary, by_use binary, counts array<binary>, sizes array<int>, "
          "levels array<int>, steps array<int>, times array<long>")


def _flat(table: pa.Table | pa.RecordBatch, name: str, dtype) -> np.ndarray:
    values = table.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype)


def _gather(facts: Facts):
    """A block's documents with the counts of all its n-grams, and what its training tokens say about the shares."""
    def run(table: pa.Table) -> pa.Table:
        level = table["level"].to_numpy()
        docs = table.filter(pa.array(level == 0))
        lens, n_words = _flat(docs, "lens", np.int64), docs["n"][0].as_py()
        ids = _unpack_ids(docs["ids"][0].as_py(), docs["by_use"][0].as_py(), int(lens.sum()), n_words)
        words = _unpack_keys(docs["hashes"][0].as_py(), n_words, False)[0]
        grams = Grams(ids, lens, n_words, facts.order)
        keys = grams.hashes(words)
        counts = []
        for k in range(facts.order):
            rows = sorted(table.filter(pa.array(level == k + 1)).select(["range", "n", "counts"]).to_pylist(), key=lambda r: r["range"])
            sums = np.concatenate([unpack(r["counts"], r["n"]) for r in rows] or [np.zeros(0, np.uint64)]).astype(np.int64)
            if k:
                by_hash, sums_ = np.argsort(keys[k], kind="stable"), sums
                sums = np.empty(len(by_hash), np.int64)
                sums[by_hash] = sums_
            counts.append(sums)
        automaton = Automaton(grams, counts, facts, [np.full(64, 0.5)] * (facts.order - 1))
        weight = np.repeat(_flat(docs, "train", np.float64), lens)
        found = [automaton.evidence(k, weight) for k in range(1, facts.order)]
        columns = {name: docs[name] for name in ("doc_ids", "train", "lens", "ids", "by_use")}
        columns["counts"] = pa.array([[pack(c.astype(np.uint64)) for c in counts]], pa.list_(pa.binary()))
        columns["sizes"] = pa.array([[len(c) for c in counts]], pa.list_(pa.int32()))
        levels = [np.full(len(k), i + 2) for i, (k, _) in enumerate(found)]
        empty = [np.zeros(0, np.int64)]
        columns["levels"] = pa.array([np.concatenate(levels + empty)], pa.list_(pa.int32()))
        columns["steps"] = pa.array([np.concatenate([k for k, _ in found] + empty)], pa.list_(pa.int32()))
        columns["times"] = pa.array([np.concatenate([n for _, n in found] + empty)], pa.list_(pa.int64()))
        return pa.table(columns)
    return run


def _score_batches(facts: Facts, shares: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                lens, sizes = _flat(row, "lens", np.int64), _flat(row, "sizes", np.int64).tolist()
                ids = _unpack_ids(row.column("ids")[0].as_py(), row.column("by_use")[0].as_py(), int(lens.sum()), sizes[0])
                counts = [unpack(c, n).astype(np.int64) for c, n in zip(row.column("counts").to_pylist()[0], sizes, strict=True)]
                automaton = Automaton(Grams(ids, lens, sizes[0], facts.order), counts, facts, shares)
                own = np.ones(len(ids), bool)
                own[np.cumsum(lens) - lens] = False
                doc, c = np.repeat(np.arange(len(lens)), lens)[own], counts[0][ids[own]]
                base = np.bincount(doc, np.log10((c + 1) / (facts.tokens + facts.words + 1)), len(lens))
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(~_flat(row, "train", bool)), pa.array(lens - 1),
                     pa.array(np.bincount(doc, c > 0, len(lens)).astype(np.int64)), pa.array(np.full(len(lens), facts.tokens)),
                     pa.array(base), pa.array(automaton.traverse(ids, lens))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), is_training(F.col("doc_id")).alias("trains"))
    size = texts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ranges = max(1, math.ceil(size["bytes"] / RANGE_BYTES))
    path, schema = scratch_path(docs.sparkSession, "grams"), f"{_CELL}, {_DOCS}"
    asked = texts.mapInArrow(_ask(order, ranges, BLOCK_BYTES), schema).withColumn("asks", F.col("level") > 0)
    asked.write.option("compression", "zstd").partitionBy("asks").parquet(path)
    blocks, asked = (docs.sparkSession.read.schema(schema).parquet(f"{path}/asks={x}") if size["rows"] else asked for x in ("false", "true"))
    replies = stage(asked.select("block", "level", "range", "n", "keys", "counts").groupBy("level", "range").applyInArrow(_sum_range, _REPLY), "counts")
    release(docs.sparkSession, f"{path}/asks=true")  # answered, and the answers are written
    row = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "once")]).first()
    facts = Facts(row["tokens"], row["words"], row["once"], order)
    parts = (blocks.select("block", "level", "range", "n", *_NAMES[6:])
             .unionByName(replies.select("block", "level", "range", "n", "counts"), allowMissingColumns=True))
    model = stage(parts.groupBy("block").applyInArrow(_gather(facts), _MODEL), "automata")
    evidence = (model.select(F.explode(F.arrays_zip("levels", "steps", "times")).alias("e"))
                .groupBy(F.col("e.levels").alias("level"), F.col("e.steps").alias("step")).agg(F.sum("e.times").alias("n")))
    shares = fit_shares({(r["level"], r["step"] // 512, r["step"] % 512): r["n"] for r in evidence.collect()}, order)
    return (model.select("doc_ids", "train", "lens", "ids", "by_use", "counts", "sizes")
            .mapInArrow(_score_batches(facts, shares), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                                       "base_score double, score double"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
