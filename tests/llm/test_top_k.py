import math
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowpane.llm import top_k
from flowpane.llm.top_k import ImpactIndex, quantised, search


def test_index_against_brute_force():
    rng = np.random.default_rng(4)
    for n, d, spread in [(500, 8, 40), (500, 8, 1), (7, 3, 5), (900, 64, 12)]:
        x = rng.integers(-spread, spread + 1, (n, d))
        ids = rng.permutation(n)
        index = ImpactIndex(ids, x)
        for q in range(0, n, 41):
            scores = x @ x[q]
            order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
            got, found = index.search(int(ids[q]), x[q], 20)
            assert got.tolist() == ids[order].tolist() and found.tolist() == scores[order].tolist()


def test_search(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 64)
    monkeypatch.setattr(top_k, "BLOCK_QUERIES", 4)
    rng = random.Random(1)
    rows = [("r", i, [rng.gauss(0, 0.2) for _ in range(6)], 1) for i in range(300)]
    rows += [("r", 400 + i, [0.5] * 6, 1) for i in range(30)] + [("r", 440, None, 1), ("r", 460, [0.1, None] * 3, 1), ("r", 480, [math.nan] * 6, 1),
             ("r", 481, [math.inf] * 6, 2), ("r", None, [0.1] * 6, 1), ("r", 500, [0.3] * 4, 1), ("r", 501, [0.2] * 4, 1), ("r", 520, [], 1), ("r", 501, [0.2] * 4, 1), ("r", 500, [0.1] * 4, 1), ("r", 20, [-0.3, 0.4] * 3, 1)]
    docs = spark.createDataFrame(rows, "rank string, vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in search(quantised(docs), quantised(docs).filter(F.col("vec_id") % 20 == 0)).collect()]
    ok = [(r[1], [math.floor(64 * x) for x in r[2]]) for r in rows if r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    want = []
    for q, v in ok:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])]
    assert sorted(got) == sorted(want)
    assert search(quantised(docs.filter("false")), quantised(docs.filter("false"))).count() == 0


def _block(ids, x, asked):
    """The answer of a block to the queries in the rows ``asked``, by query, and the CPU seconds that it took."""
    rows = [*x.tolist(), *x[asked].tolist()]
    table = pa.table({"query": pa.array([None] * len(x) + list(range(len(asked))), pa.int64()),
                      "vec_id": pa.array([*ids.tolist(), *ids[asked].tolist()], pa.int64()), "v": pa.array(rows, pa.list_(pa.int64()))})
    run, began = top_k._search_block(20), time.process_time()
    out = run(table)
    took, found = time.process_time() - began, {}
    for q, i, s in zip(*(out[c].to_pylist() for c in ("query", "vec_id", "score")), strict=True):
        found.setdefault(q, []).append((i, s))
    return found, took


def test_many_queries_of_a_block():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 8, (12_000, 64)).astype(np.int64)
    ids, asked = rng.permutation(len(x)), np.arange(600)
    found, took = _block(ids, x, asked)
    assert took < 3  # query by query it took over 10
    for n in range(0, 600, 60):
        scores = x @ x[n]
        assert found[n] == [(ids[i], scores[i]) for i in np.lexsort((ids, -scores)) if i != n][:20]


def test_copies_ties_and_large_numbers():
    rng = np.random.default_rng(7)
    few = rng.integers(-9, 10, (5, 6))
    alike, near = np.repeat(few[:1], 9_000, axis=0), few[rng.integers(0, 5, 9_000)] + (rng.random((9_000, 6)) < 0.1)
    for x in (alike, near, near << 26, near << 50, np.zeros((30, 4), np.int64), rng.integers(-3, 4, (21, 3))):
        ids, asked = rng.integers(0, 2 * len(x) // 3, len(x)), np.arange(0, len(x), max(1, len(x) // 7))
        found, _ = _block(ids, x, asked)
        for n, row in enumerate(asked):
            scores = x @ x[row]
            assert found[n] == [(ids[i], scores[i]) for i in np.lexsort((ids, ~scores)) if ids[i] != ids[row]][:20]
