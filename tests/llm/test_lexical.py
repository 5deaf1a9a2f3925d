import math
import random
import re
from collections import Counter

from flowpane.llm import lexical
from flowpane.llm.lexical import index_terms, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    """Every document scored for every item."""
    bags = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, bag, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                    for t, c in asked.items() if t in bag)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def made(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    text = lambda size: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=size))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (2000, None), (2001, ""), (2002, " .,;!"), (None, docs[7][1]), (3000, text(20_000)), (3001, "  x y İ ß")]
    items = [(i, text(12)) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere-to be_found zz"), (28, docs[5][1]), (28, docs[7][1]), (29, "w0é " * 40)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([("t", i, t, 1) for i, t in docs], "terms string, doc_id long, text string, n int").repartition(5)
    return d, spark.createDataFrame([("q", i, t, 1) for i, t in items], "query string, item_id long, text string, id int").repartition(2)


def test_search_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 40)
    monkeypatch.setattr(lexical, "FIRST_STEP", 8)
    docs, items = made()
    d, q = frames(spark, docs, items)
    rows = search(index_terms(d, "doc_id"), index_terms(q, "item_id")).collect()
    assert sorted(map(tuple, rows), key=repr) == plain(docs, items)


def test_batches_and_small_sketches(spark, monkeypatch):
    """Several batches of queries, and so few slots that nearly all terms share one."""
    monkeypatch.setattr(lexical, "BATCH_TERMS", 60)
    monkeypatch.setattr(lexical, "SLOTS", 4)
    docs, items = made(8, 120)
    d, q = frames(spark, docs, items)
    rows = search(index_terms(d, "doc_id"), index_terms(q, "item_id"), 5).collect()
    assert sorted(map(tuple, rows), key=repr) == plain(docs, items, 5)


def test_bound_stops_early(spark):
    """With few documents near the query, most are ruled out by their bounds."""
    docs = [(i, f"common{i % 3} filler{i}") for i in range(3000)] + [(5000 + i, "rare word pair here") for i in range(25)]
    d, q = frames(spark, docs, [(1, "rare word pair common1")])
    index, items = index_terms(d.coalesce(1), "doc_id"), index_terms(q, "item_id")
    assert sorted(map(tuple, search(index, items).collect()), key=repr) == plain(docs, [(1, "rare word pair common1")])
    batch = lexical.Batch([r.asDict() | {"query": 0} for r in items.collect()])
    batch.weigh(3025, {})
    table = index.toArrow().combine_chunks().to_batches()[0]
    (_, n, doc, hashes, counts), *_ = lexical._blocks(iter([table]))
    block = lexical.Block(batch, n, doc, hashes, counts, 3025, 6100)
    bound = block.bounds(batch.slots())[:, 0]
    exact = block.scores(lexical.np.arange(len(n)), 0)
    assert (bound >= exact).all() and (bound > 0).sum() < 0.6 * len(n)


def test_empty_tables(spark):
    d, q = frames(spark, [(1, "a b")], [(1, "a")])
    assert search(index_terms(d.filter("false"), "doc_id"), index_terms(q, "item_id")).count() == 0
    assert search(index_terms(d, "doc_id"), index_terms(q.filter("false"), "item_id")).count() == 0
    assert [tuple(r) for r in search(index_terms(d, "doc_id"), index_terms(q, "item_id")).collect()] == plain([(1, "a b")], [(1, "a")])
