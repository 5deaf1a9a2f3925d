"""Exact token counts at every prefix of a text, by a dynamic programme over prefixes.

A byte-pair encoding has this property: the encoding of a prefix is the encoding of a shorter prefix and one more token,
and that token is the only one that ends there and may stand next to the shorter prefix's last token. So one pass over a
pretoken gives the last token and the count of every prefix; a prefix that ends a text takes the token's word-end form.
Questions about truncation and budgets are then look-ups in the counts and never encode again.

Positions are code points of the text after the vocabulary's normaliser (composed, lower case, a run of white space as one
space); where that keeps lengths they are positions of the text itself.

Defined results: a null or empty text, or one of white space alone, has 0 tokens and an empty list of counts; a null doc_id
is kept; repeated rows give repeated results; an empty table an empty one. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import SegmentTable, sums_by, text_groups, text_or_empty
from flowpane.llm.vocab import WHITE_SPACE, WORD_BPE, chunk_pretokens, space_chunks, vocabulary_path, word_tokenizer

LIMIT = 2048
#: Pretokens up to this length are kept with their counts.
_KEEP = 64
_CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])


class Merges:
    """Tokens of a word vocabulary by the merge that makes them, and which two tokens may stand side by side."""

    def __init__(self, name: str = WORD_BPE) -> None:
        with open(vocabulary_path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"]
        self.rank: dict[str, int] = dict.fromkeys(model["vocab"], -1)
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[tuple[str, str], int] = {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.made[left, right] = at
            self.rank[left + right] = at
            self.parts[left + right] = (left, right)
        self.longest = max(len(t.removesuffix(self.end)) for t in self.rank)
        self.beside: dict[tuple[str, str], bool] = {}
        #: tokens whose own characters merge into them; others never come about
        self.whole = {t for t in self.rank if self._reached(t)}
        #: the word that was asked last, the last token and the count of its prefixes, and their counts as whole words
        self.asked, self.last, self.count, self.ended = "", [""], [0], []

    def _reached(self, token: str) -> bool:
        """Whether the merges of the token's characters end in the token."""
        stem = token.removesuffix(self.end)
        symbols = list(stem)
        if token != stem:
            symbols[-1] += self.end
        while len(symbols) > 1:
            at = min(range(len(symbols) - 1), key=lambda i: self.made.get((symbols[i], symbols[i + 1]), 1 << 30))
            if (symbols[at], symbols[at + 1]) not in self.made:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return True

    def fits(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay apart when their characters are merged together.

        Both are taken apart again, latest merge first: they stay apart unless some two parts that meet at the border
        would have merged before one of them was merged into what it became.
        """
        key = (left, right)
        known = self.beside.get(key)
        if known is not None:
            return known
        rank, bound = self.rank, 1 << 30
        while True:
            at = self.made.get((left, right))
            if at is not None and at < bound:
                ok = False
                break
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                ok = True
                break
            if a > b:
                bound, left = a, self.parts[left][1]
            else:  # a pair that starts further left is merged first, so the same rank on the left still wins
                bound, right = b + 1, self.parts[right][0]
        if len(self.beside) > 1_500_000:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def prefix_counts(self, letters: str) -> list[int]:
        """Token counts of the first 1, 2, ... letters, each taken as a whole word.

        What a word begins like the one asked before is not worked out again: nothing in a prefix depends on what follows it.
        """
        last, count, ended, before = self.last, self.count, self.ended, self.asked
        # whole once more: the letters that end the word before have no last token, for nothing of it followed
        same, most = 0, min(len(letters), len(before) - 1)
        while same < most and letters[same] == before[same]:
            same += 1
        del last[same + 1 :], count[same + 1 :], ended[same:]
        self.asked = ""  # nothing is shared with a word that was left half done
        whole, fits, known, end, longest = self.whole, self.fits, self.beside.get, self.end, self.longest
        for i in range(same + 1, len(letters) + 1):
            first = max(0, i - longest)
            for j in range(first, i):
                token = letters[j:i] + end
                if token in whole and (not j or ((ok := known((last[j], token))) is None and fits(last[j], token)) or ok):
                    ended.append(count[j] + 1)
                    break
            else:
                ended.append(None)
            if i == len(letters):
                break
            for j in range(first, i):
                token = letters[j:i]
                if token in whole and (not j or ((ok := known((last[j], token))) is None and fits(last[j], token)) or ok):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"no token ends after {letters[:i]!r}")
        self.asked = letters
        return ended[:]


class PrefixCounter:
    """Counts of a chunk's prefixes, from those of its pretokens."""

    def __init__(self, name: str = WORD_BPE) -> None:
        self.tokenizer, self.merges = word_tokenizer(name), Merges(name)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        # tuples of numbers, which the garbage collector need not walk through again and again
        self.known: dict[str, tuple[int, ...]] = {}

    def pretoken(self, letters: str) -> tuple[int, ...]:
        counts = self.known.get(letters)
        if counts is not None:
            return counts
        counts = self.merges.prefix_counts(letters)
        if letters in _CONTRACTIONS:  # its own prefixes are an apostrophe and a letter
            counts = [1, *([2] if len(letters) == 3 else []), counts[-1]]
        if not letters.isascii():
            counts = [counts[k] for k in _character_ends(letters)]
        counts = tuple(counts)
        if len(letters) <= _KEEP:
            self.known[letters] = counts
        return counts

    def plain(self, parts: list[str], before: int, out: list[int]) -> int:
        for letters in parts:
            counts = self.pretoken(letters)
            out.extend([before + c for c in counts] if before else counts)
            before += counts[-1]
        return before

    def chunk(self, chunk: str) -> list[int]:
        return list(self.of_parts(chunk, chunk_pretokens(chunk)))

    def of_parts(self, chunk: str, parts: list[str] | None) -> Sequence[int]:
        out = []
        if parts is not None:
            if len(parts) == 1:
                return self.pretoken(parts[0])
            self.plain(parts, 0, out)
            return out
        before, start = 0, 0
        for m in [*self.special.finditer(chunk), None]:
            piece = chunk[start : m.start() if m else len(chunk)]
            shown = before
            before = self.plain(self._library_pretokens(piece), before, out)
            if m:  # until it is complete, a special string is text like any other, joined to what stands before it
                joined: list[int] = []
                self.plain(self._library_pretokens(piece + m.group()[:-1]), shown, joined)
                out.extend(joined[len(joined) - len(m.group()) + 1 :])
                before += 1
                out.append(before)
                start = m.end()
        return out

    def _library_pretokens(self, text: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def values_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > 600_000:
            self.known.clear()
        parts = list(map(chunk_pretokens, chunks))
        # in order, words begin like the one before
        for letters in sorted({p for x in parts if x for p in x if len(p) <= _KEEP and p not in self.known}):
            self.pretoken(letters)
        counts = list(map(self.of_parts, chunks, parts))
        lens = np.fromiter(map(len, counts), np.int64, len(counts))
        return lens, np.fromiter(chain.from_iterable(counts), np.int32, int(lens.sum()))


@lru_cache(maxsize=1)
def _going_on() -> frozenset[str]:
    """Letters of bytes that continue a character."""
    from flowpane.llm.vocab import byte_letters
    return frozenset(byte_letters()[0x80:0xC0])


def _character_ends(letters: str) -> list[int]:
    inner = _going_on()
    return [i for i in range(len(letters)) if i + 1 == len(letters) or letters[i + 1] not in inner]


_TABLES: dict[str, SegmentTable] = {}


def prefix_table(tokenizer: str) -> SegmentTable:
    if tokenizer not in _TABLES:
        _TABLES[tokenizer] = SegmentTable(PrefixCounter(tokenizer).values_of, np.int32, 600_000)
    return _TABLES[tokenizer]


def _longest_prefix(counts: np.ndarray, base: int, limit: int) -> int:
    within = np.flatnonzero(counts + base <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def _count_batches(tokenizer: str, limit: int):
    """(doc_id, n_tokens, code points of the longest prefix of at most ``limit`` tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(tokenizer)
        for batch in batches:
            for start, texts in text_groups(batch.column(1)):
                at, n_chunks = table.numbers([space_chunks(x) for x in texts])
                ragged = table.ragged
                lens = ragged.lens(at)
                totals = ragged.flat[ragged.starts[at] + lens - 1].astype(np.int64)
                n_tokens = sums_by(n_chunks, totals)
                # a space before every chunk but the first, where the text has none, and after the last, where it has one
                front = np.array([bool(x) and x[0] in WHITE_SPACE for x in texts], np.int64)
                back = np.array([bool(x) and x[-1] in WHITE_SPACE for x in texts], np.int64)
                cut = sums_by(n_chunks, lens) + np.maximum(n_chunks - 1, 0) + np.where(n_chunks > 0, front + back, np.minimum(front, 1))
                ends = np.cumsum(n_chunks)
                for i in np.flatnonzero(n_tokens > limit).tolist():
                    a, b = int(ends[i] - n_chunks[i]), int(ends[i])
                    sums = np.cumsum(totals[a:b])
                    k = int(np.searchsorted(sums, limit, side="right"))
                    base = int(sums[k - 1]) if k else 0
                    first = int(ragged.starts[at[a + k]])
                    # the space before a chunk costs nothing
                    cut[i] = front[i] + int(lens[a : a + k].sum()) + k + _longest_prefix(ragged.flat[first : first + int(lens[a + k])], base, limit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)),
                                                  pa.array(n_tokens), pa.array(cut)], names=["doc_id", "n_bytes", "n_tokens", "chars_within"])
    return run


def token_counts(docs: DataFrame, limit: int = LIMIT, tokenizer: str = WORD_BPE) -> DataFrame:
    """Per document: n_bytes, n_tokens, whether it is over ``limit``, and its longest prefix within ``limit`` (code points)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(_count_batches(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, chars_within long")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within"))


def _prefix_batches(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(tokenizer)
        for batch in batches:
            for start, texts in text_groups(batch.column(1)):
                parts = [space_chunks(x) for x in texts]
                at, n_chunks = table.numbers(parts)
                done, rows = 0, []
                for text, n in zip(texts, n_chunks.tolist(), strict=True):
                    out = [0] if text and text[0] in WHITE_SPACE else []
                    base = 0
                    for k, x in enumerate(at[done : done + n].tolist()):
                        if k:
                            out.append(base)
                        own = table.ragged.flat[table.ragged.starts[x] : table.ragged.starts[x + 1]]
                        out.extend((own + base).tolist())
                        base = out[-1]
                    if n and text[-1] in WHITE_SPACE:
                        out.append(base)
                    done += n
                    rows.append(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(rows, pa.list_(pa.int32()))],
                                                 names=["doc_id", "counts"])
    return run


def prefix_counts(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """(doc_id, counts): ``counts[p]`` is the token count of the first p + 1 code points of the normalised text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_prefix_batches(tokenizer), "doc_id long, counts array<int>")


def tokens_before(position: int, counts: str = "counts") -> Column:
    """Tokens of the first ``position`` code points (of all, if there are fewer)."""
    at = F.least(F.lit(position), F.size(counts))
    return F.when(at <= 0, 0).otherwise(F.element_at(counts, F.greatest(at, F.lit(1))))


def longest_within(limit: int, counts: str = "counts") -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens."""
    kept = F.transform(counts, lambda c, i: F.when(c <= limit, i + 1).otherwise(0))
    return F.coalesce(F.array_max(kept), F.lit(0))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
