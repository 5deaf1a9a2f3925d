"""Public vocabularies, opened once per worker, and exact encodings of single segments of text."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"
#: Pretokens whose ids an encoder keeps; only time depends on it.
KNOWN_PRETOKENS = 250_000

#: White space as the word vocabulary's normaliser sees it (Unicode White_Space).
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = re.compile(f"[{WHITE_SPACE}]+")
#: str.split() also cuts at these four, which are no White_Space.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Below U+0300 nothing composes and letters have one lower case, so the split can be done here.
_BEYOND = re.compile(f"[{chr(0x300)}-{chr(0x10FFFF)}]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return name if os.path.isabs(name) else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def word_tokenizer(name: str = WORD_BPE):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=4)
def byte_ranks(name: str = BYTE_BPE) -> dict[bytes, int]:
    with open(vocabulary_path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def byte_encoding(name: str = BYTE_BPE):
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(name), special_tokens={})


@lru_cache(maxsize=2)
def piece_processor(name: str = PIECE_BPE):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))


def space_chunks(text: str) -> list[str]:
    """The text between white space. No pretoken of the word vocabulary spans white space, so chunks encode alone."""
    return [x for x in _SPLIT.split(text) if x] if _SEPARATORS.search(text) else text.split()


def space_chunk_lists(texts: pa.Array) -> pa.ListArray:
    """The chunks of every text, cut in Arrow; some are empty, and have no ids."""
    if pc.any(pc.match_substring_regex(texts, r"[\x1c-\x1f]")).as_py():
        return pa.array([space_chunks(x) for x in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
    return [moved.get(b, chr(b)) for b in range(256)]


@lru_cache(maxsize=1)
def _low_classes() -> re.Pattern:
    import unicodedata
    low = [chr(i) for i in range(0x300)]
    letters = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "L")
    digits = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+")


def chunk_pretokens(chunk: str) -> list[str] | None:
    """Pretokens of a chunk without white space, in byte letters; None if only the library can tell."""
    if _BEYOND.search(chunk) or "<|" in chunk:
        return None
    chunk = chunk.lower()
    if _BEYOND.search(chunk):
        return None
    found = _low_classes().findall(chunk)
    if chunk.isascii() and chunk.isprintable():
        return found
    letters = byte_letters()
    return [x if x.isalpha() and x.isascii() else "".join([letters[b] for b in x.encode()]) for x in found]


class WordEncoder:
    """Ids of chunks by the tokenizers library: its model on every distinct pretoken, its whole pipeline where needed.

    ``fixed`` gives the ids of pretokens that the model is not asked for; they outlast the cache.
    """

    def __init__(self, name: str = WORD_BPE, fixed: dict[str, list[int]] | None = None) -> None:
        self.tokenizer = word_tokenizer(name)
        self.model = self.tokenizer.model
        self.fixed = fixed or {}
        # tuples of numbers, which the garbage collector need not walk through again and again
        self.known: dict[str, Sequence[int]] = dict(self.fixed)

    def pretoken(self, letters: str) -> Sequence[int]:
        ids = self.known.get(letters)
        if ids is None:
            ids = self.known[letters] = tuple([t.id for t in self.model.tokenize(letters)])
        return ids

    def chunk(self, chunk: str) -> Sequence[int]:
        parts = chunk_pretokens(chunk)
        if parts is None:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        if len(parts) == 1:
            return self.pretoken(parts[0])
        return tuple([i for x in parts for i in self.pretoken(x)])

    def values_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KNOWN_PRETOKENS:
            self.known = dict(self.fixed)
        ids = list(map(self.chunk, chunks))
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return lens, np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum()))
