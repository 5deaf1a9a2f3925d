"""Phrase collocations per language, counted in weighted acyclic automata.

1. A shard of the documents sorts its 1- to 3-grams of a language and closes them, in that order, into a count transducer: an
   acyclic automaton over words whose arcs carry counts; states with equal continuations and counts are one state.
2. Splitters, sampled from the n-grams of all shards, cut (language, first word, second word) into prefix ranges of bounded size,
   so that a frequent first word is spread over several. Every transducer is cut there; the pieces of a range are united, counts
   of equal paths summed, and paths under the least count leave.
3. The parts of a range's candidates form an acceptor, cut at the same splitters and sent, one piece to each range that holds its
   prefixes. There it is composed with the range's transducer, and the weights of its paths go back, in order.
4. Candidates are scored by their worst cut, those contained in a longer one of at least half their count leave, and each
   language's first rows are kept, pruned before the shuffle.

A word that is in every text is one arc per shard and range; no n-gram is gathered over its occurrences.

Defined results: null texts count as empty; a null language is ``und`` and one with a language of that name; repeated rows count
each; texts under two words add to ``n`` alone; a language without candidates has no rows; an empty table gives an empty result.
Only text and lang are read. Scores are computed with unbounded integers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowpane.llm.common import Interned, ragged_index, stage, text_groups, text_or_empty
from flowpane.llm.packing import pack_many, unpack_many

LEAST_COUNT, TOP, SCALE = 10, 2000, 1_000_000
#: A candidate leaves if a longer one that contains it has at least this share (in hundredths) of its count.
CONTAINED = 50
#: Bytes of text in a shard; n-grams of all shards in a prefix range, about; sampled n-grams per range.
SHARD_BYTES, RANGE_GRAMS, OVERSAMPLING = 32_000_000, 4_000_000, 12
_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text with a break between pieces (and none at the ends)."""
    return text.encode().translate(_FOLD).replace(_BREAK, b" \xff ").split()


# --- count transducers ----------------------------------------------------------------------------------------------

def _closed(starts: np.ndarray, *arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Arcs of states one after another, with equal states closed into one: (state of each, starts of the states kept, their arcs)."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(owner)) - starts[owner]).astype(np.uint64)
    sums = []
    with np.errstate(over="ignore"):
        for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            x = place * np.uint64(seed) + np.uint64(0xBF58476D1CE4E5B9)
            for a in arcs:
                x = (x ^ a.astype(np.uint64)) * np.uint64(seed)
                x ^= x >> np.uint64(29)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.uint64(0x94D049BB133111EB), dtype=np.uint64)])
            sums.append(total[starts[1:]] - total[starts[:-1]])
    order = np.lexsort((sums[1], sums[0], sizes))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(sizes[order]) != 0) | (np.diff(sums[0][order]) != 0) | (np.diff(sums[1][order]) != 0)
    kept = order[new]
    state = np.empty(len(order), np.int64)
    state[order] = np.cumsum(new) - 1
    at = ragged_index(starts[:-1][kept], sizes[kept])
    return state, np.concatenate([[0], np.cumsum(sizes[kept])]), [a[at] for a in arcs]


class Grams:
    """Sorted n-grams with counts: words, (w1), (index of w1's row, w2), (index of the pair's row, w3)."""

    def __init__(self, words: list[bytes], one: np.ndarray, f1: np.ndarray, of_one: np.ndarray, two: np.ndarray, f2: np.ndarray,
                 of_two: np.ndarray, three: np.ndarray, f3: np.ndarray) -> None:
        self.words = words
        self.one, self.f1, self.of_one, self.two, self.f2, self.of_two, self.three, self.f3 = one, f1, of_one, two, f2, of_two, three, f3

    @classmethod
    def count(cls, words: list[bytes], ids: np.ndarray) -> Grams:
        """N-grams of word numbers, -1 at breaks; ``words`` are sorted, and each occurs."""
        n = len(words)
        one, f1 = np.arange(n), np.bincount(ids[ids >= 0], minlength=n)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        codes2, pair, f2 = np.unique(ids[at] * n + ids[at + 1], return_inverse=True, return_counts=True)
        more = at + 2 < len(ids)
        more[more] = ids[at[more] + 2] >= 0
        codes3, f3 = np.unique(pair[more] * n + ids[at[more] + 2], return_counts=True)
        return cls(words, one, f1, codes2 // n, codes2 % n, f2, codes3 // n, codes3 % n, f3)

    @property
    def size(self) -> int:
        return len(self.one) + len(self.two) + len(self.three)

    def first(self) -> np.ndarray:
        """The first word of every pair."""
        return self.one[self.of_one]

    def cut(self, splitters: list[tuple[bytes, bytes]]) -> Iterator[Grams]:
        """The n-grams of each prefix range; a word belongs where it stands alone, with count 0 where only its pairs do."""
        n = len(self.words)
        codes = self.first() * n + self.two
        ones, twos = [0], [0]
        for a, b in splitters:
            i = bisect_left(self.words, a)
            exact = i < n and self.words[i] == a
            ones.append(int(np.searchsorted(self.one, i + exact)))
            twos.append(int(np.searchsorted(codes, i * n + (bisect_left(self.words, b) if exact else 0))))
        ones.append(len(self.one))
        twos.append(len(self.two))
        threes = np.searchsorted(self.of_two, twos)
        for (a, b), (c, d), (e, f) in zip(zip(ones, ones[1:]), zip(twos, twos[1:]), zip(threes, threes[1:]), strict=True):
            rows = np.union1d(np.arange(a, b), self.of_one[c:d])
            own = (rows >= a) & (rows < b)
            yield Grams(self.words, self.one[rows], np.where(own, self.f1[rows], 0), np.searchsorted(rows, self.of_one[c:d]), self.two[c:d], self.f2[c:d],
                        self.of_two[e:f] - c, self.three[e:f], self.f3[e:f]).compact()

    def compact(self) -> Grams:
        """The same n-grams with only the words they use."""
        used = np.unique(np.concatenate([self.one, self.two, self.three]))
        one, two, three = (np.searchsorted(used, x) for x in (self.one, self.two, self.three))
        return Grams([self.words[i] for i in used.tolist()], one, self.f1, self.of_one, two, self.f2, self.of_two, three, self.f3)

    def to_bytes(self) -> bytes:
        """The count transducer of these n-grams: arcs of the root, of states after one word, and of states after two."""
        starts3 = np.searchsorted(self.of_two, np.arange(len(self.two) + 1))
        state2, s3, (l3, w3) = _closed(starts3, self.three, self.f3)
        starts2 = np.searchsorted(self.of_one, np.arange(len(self.one) + 1))
        state1, s2, (l2, w2, t2) = _closed(starts2, self.two, self.f2, state2)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        return pack_many([sizes, np.frombuffer(b"".join(self.words), np.uint8), np.diff(self.one, prepend=0), self.f1, state1,
                          np.diff(s2), l2, w2, t2, np.diff(s3), l3, w3])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Grams:
        """The n-grams along all paths, in order."""
        sizes, letters, l1, f1, t1, n2, l2, w2, t2, n3, l3, w3 = unpack_many(raw)
        text, ends = letters.astype(np.uint8).tobytes(), np.cumsum(sizes)
        words = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        at2 = ragged_index((np.cumsum(n2) - n2)[t1], n2[t1])
        after = t2[at2]
        at3 = ragged_index((np.cumsum(n3) - n3)[after], n3[after])
        return cls(words, np.cumsum(l1), f1, np.repeat(np.arange(len(l1)), n2[t1]), l2[at2], w2[at2], np.repeat(np.arange(len(at2)), n3[after]), l3[at3], w3[at3])

    @classmethod
    def union(cls, parts: list[Grams]) -> Grams:
        """All n-grams of the parts, counts of equal ones summed."""
        words = sorted(set().union(*[p.words for p in parts]))
        number = {w: i for i, w in enumerate(words)}
        n = len(words)
        to = [np.fromiter(map(number.__getitem__, p.words), np.int64, len(p.words)) for p in parts]
        joined = lambda arrays: np.concatenate(arrays)
        one, at1 = np.unique(joined([t[p.one] for t, p in zip(to, parts)]), return_inverse=True)
        rows1 = np.cumsum([0] + [len(p.one) for p in parts])
        codes2, at2 = np.unique(joined([at1[r + p.of_one] * n + t[p.two] for t, p, r in zip(to, parts, rows1)]), return_inverse=True)
        rows2 = np.cumsum([0] + [len(p.two) for p in parts])
        codes3, at3 = np.unique(joined([at2[r + p.of_two] * n + t[p.three] for t, p, r in zip(to, parts, rows2)]), return_inverse=True)
        summed = lambda at, size, name: np.bincount(at, joined([getattr(p, name) for p in parts]), size).astype(np.int64)
        return cls(words, one, summed(at1, len(one), "f1"), codes2 // n, codes2 % n, summed(at2, len(codes2), "f2"),
                   codes3 // n, codes3 % n, summed(at3, len(codes3), "f3"))

    def prune(self, least: int) -> Grams:
        """The n-grams of at least that count (and the words before them)."""
        keep3, keep2 = self.f3 >= least, self.f2 >= least
        keep1 = self.f1 >= least
        keep1[self.of_one[keep2]] = True
        new = lambda keep: np.cumsum(keep) - 1
        return Grams(self.words, self.one[keep1], self.f1[keep1], new(keep1)[self.of_one[keep2]], self.two[keep2], self.f2[keep2],
                     new(keep2)[self.of_two[keep3]], self.three[keep3], self.f3[keep3]).compact()

    def parts(self) -> Grams:
        """An acceptor (counts 0) of the parts of all phrases: single words and pairs."""
        n = len(self.words)
        first = self.first()
        of = self.of_two
        pairs = np.unique(np.concatenate([first[of] * n + self.two[of], self.two[of] * n + self.three]))
        one = np.unique(np.concatenate([first, self.two, self.three, pairs // n]))
        zero = lambda x: np.zeros(len(x), np.int64)
        return Grams(self.words, one, zero(one), np.searchsorted(one, pairs // n), pairs % n, zero(pairs), zero([]), zero([]), zero([])).compact()

    def compose(self, asked: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Counts of an acceptor's words and pairs: both automata read the same words from their roots."""
        number = {w: i for i, w in enumerate(self.words)}
        to = np.fromiter((number.get(w, -1) for w in asked.words), np.int64, len(asked.words))

        def found(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            return np.where((codes[at] == wanted) & (wanted >= 0), at, -1) if len(codes) else np.full(len(wanted), -1)

        row1 = found(self.one, to[asked.one])
        before, word = row1[asked.of_one], to[asked.two]
        wanted = np.where((before >= 0) & (word >= 0), before * len(self.words) + word, -1)
        row2 = found(self.of_one * len(self.words) + self.two, wanted)
        weight = lambda row, f: np.where(row >= 0, f[row], 0) if len(f) else np.zeros(len(row), np.int64)
        return weight(row1, self.f1), weight(row2, self.f2)


# --- shards ---------------------------------------------------------------------------------------------------------

_SHARD = "lang string, words long, grams long, automaton binary, w1 array<binary>, w2 array<binary>"
#: N-grams between two that a shard offers as splitters.
SAMPLE_STEP = 20_000


class _Shard:
    def __init__(self) -> None:
        self.words, self.ids = Interned(), []
        self.words[_BREAK]

    def add(self, text: str) -> int:
        part = words_of(text)
        self.ids.append(np.array([*map(self.words.__getitem__, part), 0], np.int64))
        return len(text)

    def row(self, lang: str) -> tuple:
        words = list(self.words)[1:]
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.full(len(words) + 1, -1)
        rank[np.array(order, np.int64) + 1] = np.arange(len(words))
        ids = rank[np.concatenate(self.ids)]
        grams = Grams.count([words[i] for i in order], ids)
        weights = np.cumsum(1 + np.bincount(grams.of_two, minlength=len(grams.two)))
        some = np.searchsorted(weights, np.arange(SAMPLE_STEP // 2, int(weights[-1]) if len(weights) else 0, SAMPLE_STEP))
        first = grams.first()
        return (lang, int((ids >= 0).sum()), grams.size, grams.to_bytes(), [grams.words[i] for i in first[some].tolist()],
                [grams.words[i] for i in grams.two[some].tolist()])


_SHARD_TYPES = [("lang", pa.string()), ("words", pa.int64()), ("grams", pa.int64()), ("automaton", pa.binary()),
                ("w1", pa.list_(pa.binary())), ("w2", pa.list_(pa.binary()))]


def _batch(row: tuple, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, types, strict=True)], names=[n for n, _ in types])


def _shard_batches(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, size = {}, 0
        for batch in batches:
            for start, texts in text_groups(batch.column(1)):
                langs = batch.column(0).slice(start, len(texts)).to_pylist()
                for lang, text in zip(langs, texts, strict=True):
                    if lang not in shards:
                        shards[lang] = _Shard()
                    size += shards[lang].add(text)
                    if size > shard_bytes:
                        yield from (_batch(shards.pop(k).row(k), _SHARD_TYPES) for k in list(shards))
                        size = 0
        yield from (_batch(shards.pop(k).row(k), _SHARD_TYPES) for k in list(shards))
    return run


# --- prefix ranges --------------------------------------------------------------------------------------------------

Splitter = tuple[str, bytes, bytes]


def _ranges_of(splitters: list[Splitter], lang: str) -> tuple[int, list[tuple[bytes, bytes]]]:
    """The first range that holds n-grams of a language, and the splitters within it."""
    a, b = bisect_left(splitters, (lang,)), bisect_left(splitters, (lang + "\0",))
    return a, [s[1:] for s in splitters[a:b]]


def choose_splitters(shards: DataFrame) -> list[Splitter]:
    """Splitters such that ranges hold about ``RANGE_GRAMS`` n-grams each: a sorted list with one entry per range."""
    total = shards.agg(F.coalesce(F.sum("grams"), F.lit(0)).alias("g")).first()["g"]
    ranges = math.ceil(total / RANGE_GRAMS)
    if ranges <= 1:
        return []
    offered = shards.select("lang", F.explode(F.arrays_zip("w1", "w2")).alias("s")).select("lang", "s.w1", "s.w2")
    share = min(1.0, OVERSAMPLING * ranges * SAMPLE_STEP / total)
    drawn = F.pmod(F.xxhash64("lang", "w1", "w2", F.monotonically_increasing_id()), F.lit(1 << 20)) < share * (1 << 20)
    picked = offered.filter(drawn).collect()
    picked = sorted((r["lang"], bytes(r["w1"]), bytes(r["w2"])) for r in picked)
    return sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)}) if picked else []


_PIECE = "range int, lang string, automaton binary"
_PIECE_TYPES = [("range", pa.int32()), ("lang", pa.string()), ("automaton", pa.binary())]


def _cut_batches(splitters: list[Splitter]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start, inside = _ranges_of(splitters, lang)
                for i, piece in enumerate(Grams.from_bytes(raw.as_py()).cut(inside)):
                    if piece.size:
                        yield _batch((start + i, lang, piece.to_bytes()), _PIECE_TYPES)
    return run


def _unite(least: int):
    """The pieces of a range and language as one transducer; a binary tree of unions keeps memory near that of the result."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        waiting: list[tuple[int, Grams]] = []
        for raw in table["automaton"]:
            waiting.append((0, Grams.from_bytes(raw.as_py())))
            while len(waiting) > 1 and waiting[-1][0] == waiting[-2][0]:
                (level, a), (_, b) = waiting.pop(), waiting.pop()
                waiting.append((level + 1, Grams.union([b, a])))
        grams = Grams.union([g for _, g in waiting]).prune(least)
        row = (key[0].as_py(), key[1].as_py(), grams.to_bytes())
        return pa.Table.from_batches([_batch(row, _PIECE_TYPES)])
    return run


# --- parts and scores -----------------------------------------------------------------------------------------------

_ASKED = "range int, lang string, source int, automaton binary"
_ASKED_TYPES = [("range", pa.int32()), ("lang", pa.string()), ("source", pa.int32()), ("automaton", pa.binary())]
_REPLY_TYPES = [("source", pa.int32()), ("lang", pa.string()), ("range", pa.int32()), ("automaton", pa.binary())]


def _ask_batches(splitters: list[Splitter]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                start, inside = _ranges_of(splitters, lang)
                for i, piece in enumerate(Grams.from_bytes(raw.as_py()).parts().cut(inside)):
                    if piece.size:
                        yield _batch((start + i, lang, source, piece.to_bytes()), _ASKED_TYPES)
    return run


def _compose_range(table: pa.Table) -> pa.Table:
    own, asked = table.filter(pc.is_null(table["source"])), table.filter(pc.is_valid(table["source"]))
    counts = Grams.from_bytes(own["automaton"][0].as_py()) if len(own) else Grams.union([Grams.count([], np.zeros(0, np.int64))])
    out = []
    for row in asked.to_pylist():
        out.append(_batch((row["source"], row["lang"], row["range"], pack_many(list(counts.compose(Grams.from_bytes(row["automaton"]))))), _REPLY_TYPES))
    return pa.Table.from_batches(out, pa.schema(_REPLY_TYPES))


def worst_cut(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut, the first of equal ones."""
    return min(((SCALE * a * a // (x * y), x, y) for x, y in cuts), key=lambda c: c[0])


_SCORED = "lang string, phrase string, n_words int, a long, l long, r long, score long, dropped array<string>"
_SCORED_TYPES = [("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
                 ("score", pa.int64()), ("dropped", pa.list_(pa.string()))]


def _score_range(splitters: list[Splitter]):
    """Candidates of a range with their scores; a phrase of three words names the pairs in it that it makes redundant."""
    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_null(table["source"])).to_pylist()
        if not own:
            return pa.schema(_SCORED_TYPES).empty_table()
        lang, grams = own[0]["lang"], Grams.from_bytes(own[0]["automaton"])
        replies = sorted(table.filter(pc.is_valid(table["source"])).to_pylist(), key=lambda r: r["range"])
        replies = {r["range"]: unpack_many(r["automaton"]) for r in replies}
        start, inside = _ranges_of(splitters, lang)
        single, pair = {}, {}
        for i, piece in enumerate(grams.parts().cut(inside)):
            if piece.size:
                f1, f2 = replies[start + i]
                single.update((piece.words[w], f) for w, f in zip(piece.one.tolist(), f1.tolist(), strict=True) if f)
                pair.update(((piece.words[a], piece.words[b]), f) for a, b, f in zip(piece.first().tolist(), piece.two.tolist(), f2.tolist(), strict=True))
        word, first = grams.words.__getitem__, grams.first()
        rows = []
        for x, y, a in zip(first.tolist(), grams.two.tolist(), grams.f2.tolist(), strict=True):
            p = word(x), word(y)
            score, left, right = worst_cut(a, [(single[p[0]], single[p[1]])])
            rows.append((lang, b" ".join(p).decode(), 2, a, left, right, score, []))
        of = grams.of_two
        for x, y, z, a in zip(first[of].tolist(), grams.two[of].tolist(), grams.three.tolist(), grams.f3.tolist(), strict=True):
            p = word(x), word(y), word(z)
            score, left, right = worst_cut(a, [(single[p[0]], pair[p[1:]]), (pair[p[:2]], single[p[2]])])
            dropped = [b" ".join(q).decode() for q in dict.fromkeys((p[:2], p[1:])) if 100 * a >= CONTAINED * pair[q]]
            rows.append((lang, b" ".join(p).decode(), 3, a, left, right, score, dropped))
        return pa.table([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True), _SCORED_TYPES, strict=True)],
                        schema=pa.schema(_SCORED_TYPES)) if rows else pa.schema(_SCORED_TYPES).empty_table()
    return run


def scored_phrases(shards: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Every candidate: lang, phrase, n_words, a, l, r, score, and the shorter phrases that it makes redundant."""
    splitters = choose_splitters(shards)
    pieces = shards.select("lang", "automaton").mapInArrow(_cut_batches(splitters), _PIECE)
    united = stage(pieces.groupBy("range", "lang").applyInArrow(_unite(least), _PIECE), "transducers")
    own = united.select("range", "lang", F.lit(None).cast("int").alias("source"), "automaton")
    asked = united.mapInArrow(_ask_batches(splitters), _ASKED)
    replies = (own.unionByName(asked).groupBy("range", "lang").applyInArrow(_compose_range, "source int, lang string, range int, automaton binary"))
    back = replies.select(F.col("source").alias("home"), "lang", "source", "range", "automaton")
    home = united.select(F.col("range").alias("home"), "lang", F.lit(None).cast("int").alias("source"), "range", "automaton")
    return stage(home.unionByName(back).groupBy("home", "lang").applyInArrow(_score_range(splitters), _SCORED), "phrases")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    shards = stage(texts.mapInArrow(_shard_batches(SHARD_BYTES), _SHARD), "shards")
    phrases = scored_phrases(shards, least)
    redundant = phrases.filter("n_words = 3").select("lang", F.explode("dropped").alias("phrase")).distinct()
    left = phrases.join(redundant, ["lang", "phrase"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = left.withColumn("rank", place).filter(F.col("rank") <= top)
    totals = shards.groupBy("lang").agg(F.sum("words").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS sizes(k)),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM grams) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE k >= 2 AND f >= 10),
cuts AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM found)),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS a
  FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS inner_phrase FROM found WHERE k = 3)
  GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.inner_phrase = w.phrase AND w.k = 2
         WHERE o.a IS NULL OR 100 * o.a < 50 * w.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
