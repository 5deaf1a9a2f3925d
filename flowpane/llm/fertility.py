"""Quality by tokeniser fertility: characters per token, byte-fallback share and token entropy against bands per language.

Every word is encoded alone by two public vocabularies: a piece vocabulary with byte fallback and a byte-level one. Over all
documents that pass the base rules, each language (the script of the text, where lang is null) gets quartiles of the
measures, and a document is rejected when a measure lies outside its fences: the quartiles widened by ``WIDTH`` times their
distance, and by no less than ``LEAST`` of the median. Quartiles come from mergeable sketches, so a hot language costs no
task more than its rows.

Defined results: a null or empty text has no words and fails the base rules; measures without words are null and reject
nothing; a null doc_id is kept; repeated rows are documents of their own; an empty table gives an empty result. Only doc_id,
text and lang are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import SegmentTable, stage, sums_by, text_groups, text_or_empty
from flowpane.llm.vocab import BYTE_BPE, PIECE_BPE, byte_encoding, piece_processor

SYMBOLS = frozenset("#*$%&|<>")
WINDOW = 3
WIDTH, LEAST = 3.0, 0.15
MEASURES = ("piece_chars", "byte_chars", "fallback_share", "entropy")
#: Share of fallback bytes that is let pass anywhere above the upper quartile.
LEAST_SHARE = 0.10
#: First code point of each script class.
SCRIPTS = ((0x0, "latin"), (0x370, "greek-cyrillic"), (0x590, "other"), (0x2E80, "east-asian"))
_ID_BITS = 16


class WordMeasures:
    """Per word: code points, symbols, piece tokens, fallback bytes, byte-level tokens, script, then the piece ids."""

    fixed = 6

    def __init__(self, pieces: str, ranks: str) -> None:
        self.pieces, self.bytes = piece_processor(pieces), byte_encoding(ranks)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def values_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        rows = []
        for text, ids in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            symbols = sum(map(SYMBOLS.__contains__, text))
            top = ord(max(text))
            script = sum(top >= first for first, _ in SCRIPTS) - 1
            rows.append([len(text), symbols, len(ids), int(self.fallback[ids].sum()) if top > 127 else 0,
                         len(self.bytes.encode_ordinary(text)), script, *ids])
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        return lens, np.fromiter((x for r in rows for x in r), np.int32, int(lens.sum()))


_TABLES: dict[tuple[str, str], SegmentTable] = {}


def _table(pieces: str, ranks: str) -> SegmentTable:
    if (pieces, ranks) not in _TABLES:
        _TABLES[pieces, ranks] = SegmentTable(WordMeasures(pieces, ranks).values_of, np.int32)
    return _TABLES[pieces, ranks]


def repeated_words(at: np.ndarray, window: int = WINDOW) -> int:
    """How many of the words (as numbers below 2 ** 21) lie in windows that are found twice or more."""
    n = len(at) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.int64)
    for j in range(window):
        keys = keys << 21 | at[j : j + n]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.searchsorted(twice, keys)
    hit = np.zeros(n + window, np.int64)
    starts = np.flatnonzero((found < len(twice)) & (twice[np.minimum(found, len(twice) - 1)] == keys))
    hit[starts] += 1
    hit[starts + window] -= 1
    return int((np.cumsum(hit) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _entropies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of the ids of each run; NaN for none."""
    doc = np.repeat(np.arange(len(counts)), counts)
    keys = np.sort(doc << _ID_BITS | ids)
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(firsts, len(keys)))
    total = np.maximum(counts, 1)
    part = sums_by(np.bincount(keys[firsts] >> _ID_BITS, minlength=len(counts)), times * np.log2(times))
    return np.where(counts > 0, np.log2(total) - part / total, np.nan)


_MEASURED = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "piece_chars double, byte_chars double, fallback_share double, entropy double")


def _measure_batches(pieces: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fixed = _table(pieces, ranks), WordMeasures.fixed
        for batch in batches:
            for start, texts in text_groups(batch.column(2), 1_000_000):
                at, n_words = table.numbers([t.encode().split() for t in texts])  # of bytes: only space and \\t-\\r separate
                if len(table.index) >= 1 << 21:
                    raise ValueError("a text of more than two million different words")
                ragged = table.ragged
                firsts, lens = ragged.starts[at], ragged.lens(at)
                chars, symbols, tokens, fallback, byte_tokens, script = (sums_by(n_words, ragged.flat[firsts + k].astype(np.int64)) if k < 5
                                                                        else ragged.flat[firsts + k] for k in range(fixed))
                values = ragged.take(at)
                ids = values[_tail_mask(lens, fixed)].astype(np.int64)
                entropy = _entropies(ids, tokens)
                ends = np.cumsum(n_words)
                repeats = [repeated_words(at[b - n : b]) for b, n in zip(ends.tolist(), n_words.tolist(), strict=True)]
                langs = batch.column(1).slice(start, len(texts)).to_pylist()
                for i, lang in enumerate(langs):
                    if lang is None:
                        own = script[ends[i] - n_words[i] : ends[i]]
                        langs[i] = "script:" + SCRIPTS[int(np.bincount(own, minlength=1).argmax()) if len(own) else 0][1]
                ratio = lambda a, b: pa.array(a / np.maximum(b, 1), mask=b == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(langs, pa.string()), pa.array(n_words), pa.array(chars), pa.array(symbols),
                     pa.array([repeated_lines(t) for t in texts], pa.int64()), pa.array(repeats, pa.int64()),
                     ratio(chars, tokens), ratio(chars, byte_tokens), ratio(fallback, tokens), pa.array(entropy, mask=n_words == 0)],
                    names=[c.split()[0] for c in _MEASURED.split(", ")])
    return run


def _tail_mask(lens: np.ndarray, fixed: int) -> np.ndarray:
    """Which values of consecutive runs of ``lens`` come after a run's first ``fixed``."""
    mask = np.ones(int(lens.sum()), bool)
    starts = np.cumsum(lens) - lens
    for k in range(fixed):
        mask[starts + k] = False
    return mask


def measured(docs: DataFrame, pieces: str = PIECE_BPE, ranks: str = BYTE_BPE) -> DataFrame:
    """Base counts and measures of every text; lang is the script where it was null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    return (rows.mapInArrow(_measure_batches(pieces, ranks), _MEASURED)
            .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def bands(rows: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """Per language the lower and upper fence of each measure, over the rows that pass the base rules."""
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]
    found = rows.filter("NOT base_failed").groupBy("lang").agg(*quartiles)
    out = [F.col("lang")]
    for m in MEASURES:
        q1, q2, q3 = (F.col(m)[k] for k in range(3))
        room = F.greatest(width * (q3 - q1), least * q2, F.lit(LEAST_SHARE if m == "fallback_share" else 0.0))
        out += [(q1 - room).alias(f"{m}_low"), (q3 + room).alias(f"{m}_high")]
    return found.select(*out)


def judged(docs: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """Base counts, measures and verdict of every document."""
    rows = stage(measured(docs), "measured")
    fences = bands(rows, width, least)
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return rows.join(fences, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
