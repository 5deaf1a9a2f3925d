"""What the corpus operators share: staged tables, bounded groups of texts, interned words with ragged values."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.session import scratch_dir

#: Characters of text that are taken apart at once in a task; a longer text is a group of its own.
GROUP_CHARS = 2_000_000
#: Distinct segments that a worker keeps between groups; beyond it the table starts anew. It is a cache: no result depends on it.
CACHE_ENTRIES = 400_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Freed memory goes back to the system where the C library can do it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_KEPT: dict = {}


def kept_in_worker(key, make: Callable):
    """What a worker keeps between tasks under ``key``. Only what was asked for last stays: a worker that serves another operator
    gives its memory back first."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those wanted that ``df`` does not have, in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_groups(texts: pa.Array, limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of a batch as Python strings, at most about ``limit`` bytes at a time, with the first row's number."""
    for start, some in text_slices(texts, limit):
        yield start, some.to_pylist()


def text_slices(texts: pa.Array, limit: int = GROUP_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """The same as arrays."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, texts.slice(start, end - start)
        start = end


class Interned(dict):
    """Numbers strings as they are met; ``new`` holds those met since the last call of ``values_for``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class Ragged:
    """An integer array per number, appended to as numbers are met."""

    def __init__(self, dtype) -> None:
        self.flat = np.empty(1 << 16, dtype)
        self.starts = np.zeros(1 << 12, np.int64)
        self.n = 0

    def extend(self, lens: np.ndarray, values: np.ndarray) -> None:
        used = int(self.starts[self.n])
        need = used + len(values)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(max(need - used, used), self.flat.dtype)])
        self.flat[used:need] = values
        if self.n + len(lens) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[: self.n + 1], np.zeros(max(len(lens), self.n) + 1, np.int64)])
        self.starts[self.n + 1 : self.n + 1 + len(lens)] = used + np.cumsum(lens)
        self.n += len(lens)

    def lens(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at + 1] - self.starts[at]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The values of all numbers in ``at``, one after another."""
        return self.flat[ragged_index(self.starts[at], self.lens(at))]


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every (start, length), one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


class SegmentTable:
    """Segments of text with an integer array each, computed for every distinct segment once per worker.

    ``values_of`` takes a list of new segments and returns (lengths, values). The table is dropped when it holds
    more than ``limit`` segments, so memory stays bounded whatever the vocabulary of the corpus.
    """

    def __init__(self, values_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.int32,
                 limit: int = CACHE_ENTRIES) -> None:
        self.values_of, self.dtype, self.limit = values_of, dtype, limit
        self.dropped = False
        self._clear()

    def _clear(self) -> None:
        self.index, self.ragged = Interned(), Ragged(self.dtype)

    def numbers(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the segments of several texts, one after another, and the count of segments of each text."""
        self._make_room()
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return self._numbered(chain.from_iterable(parts), int(counts.sum())), counts

    def numbers_of(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for lists of segments in Arrow: equal segments are found there, and each is looked up once."""
        self._make_room()
        met = parts.flatten().dictionary_encode()
        at = self._numbered(met.dictionary.to_numpy(zero_copy_only=False), len(met.dictionary))
        return at[met.indices.to_numpy()], parts.value_lengths().to_numpy().astype(np.int64)

    def number(self, segment: str) -> int:
        return int(self._numbered([segment], 1)[0])

    def _make_room(self) -> None:
        if len(self.index) > self.limit:
            self._clear()
            self.dropped = True

    def _numbered(self, segments: Iterable[str], n: int) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, segments), np.int64, n)
        new, self.index.new = self.index.new, []
        if new:
            self.ragged.extend(*self.values_of(new))
        return at


def sums_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; a run of no values sums to 0."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]
