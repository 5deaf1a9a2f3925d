import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from flowpane.llm import language_model
from flowpane.llm.language_model import LEAST_SHARE, MOST_SHARE, USUAL_SHARE, score


def made(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"É{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.randint(1, 25))) for i in range(160)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(3, docs[3][1]), (300, None), (301, ""), (302, " \t\n "), (None, "W1 w2\x0bw3 w4"), (303, text(900)),
             (304, "never seen words w1"), (305, "X " * 50)]
    return docs


def split(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def plain(docs, order):
    """The model by its formulas, with counts in dictionaries and one pass per document."""
    lower = lambda t: (t or "").encode().lower().split()
    seqs = [(i, split(i), [b"", *lower(t), b""]) for i, t in docs]
    c = Counter()
    for _, held, s in seqs:
        if not held:
            c.update(tuple(s[j - k + 1 : j + 1]) for j in range(1, len(s)) for k in range(1, order + 1) if j - k + 1 >= 0)
    words = {g: n for g, n in c.items() if len(g) == 1}
    total, distinct = sum(words.values()), len(words)
    unknown = (sum(n == 1 for n in words.values()) + 1) / (total + 2) if total else 1.0

    def chance(g, share):
        """P(last of g | the rest), None where the context is unknown."""
        if len(g) == 1:
            return (1 - unknown) * c[g] / total if c[g] else unknown
        h, lower_order = g[:-1], chance(g[1:], share)
        if not c[h]:
            return lower_order
        a = share[len(g)][int(math.log2(c[h]))]
        return a * c[g] / c[h] + (1 - a) * lower_order

    def left_out(g):
        if len(g) == 1:
            return (1 - unknown) * (c[g] - 1) / (total - 1) if c[g] > 1 else unknown
        return 0.5 * (c[g] - 1) / max(c[g[:-1]] - 1, 1) + 0.5 * left_out(g[1:])

    shares = {}
    for k in range(2, order + 1):
        ratios = {}
        for g, n in c.items():
            if len(g) == k and c[g[:-1]] > 1:
                r = (n - 1) / (c[g[:-1]] - 1) / left_out(g[1:])
                r = 2 ** (np.clip(np.rint(4 * np.log2(r)), -159, 159) / 4) if r else 0.0
                ratios.setdefault(int(math.log2(c[g[:-1]] - 1)), []).append((r, n))
        last, shares[k] = USUAL_SHARE, []
        for power in range(64):
            if power in ratios:
                r, n = (np.array(x) for x in zip(*ratios[power]))
                slope = lambda a: (n * (r - 1) / (1 + a * (r - 1))).sum()
                a, b = LEAST_SHARE, MOST_SHARE
                for _ in range(50):
                    a, b = ((a + b) / 2, b) if slope((a + b) / 2) > 0 else (a, (a + b) / 2)
                last = (a + b) / 2
            shares[k].append(last)
    out = []
    for i, held, s in seqs:
        counts = [c[(w,)] for w in s[1:]]
        base = sum(math.log10((n + 1) / (total + distinct + 1)) for n in counts)
        own = sum(math.log10(chance(tuple(s[max(0, j - order + 1) : j + 1]), shares)) for j in range(1, len(s)))
        out.append((i, held, len(counts), sum(n > 0 for n in counts), total, base, own))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_the_formulas(spark, monkeypatch, order):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 900)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 3000)
    docs = made()
    df = spark.createDataFrame([("x", i, t, 1) for i, t in docs], "counts string, doc_id long, text string, level int").repartition(4)
    got, want = rows_of(score(df, order)), sorted(plain(docs, order), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_lanes_change_nothing(spark, monkeypatch):
    """Long documents are cut where the words before determine the state; a traversal in one piece gives the same."""
    rng = np.random.default_rng(2)
    lens = np.array([700, 2, 3, 40, 258, 259])
    ids = rng.integers(1, 30, lens.sum())
    ends = np.cumsum(lens)
    ids[ends - 1] = ids[ends - lens] = 0
    for order in (1, 2, 3, 4):
        grams = language_model.Grams(ids, lens, 30, order)
        weight = np.repeat(rng.integers(0, 2, len(lens)), lens).astype(float)
        counts = [grams.counts(k, weight) for k in range(order)]
        facts = language_model.Facts(int(counts[0].sum()), int((counts[0] > 0).sum()), int((counts[0] == 1).sum()), order)
        automaton = language_model.Automaton(grams, counts, facts, [rng.uniform(0.1, 0.9, 64) for _ in range(order - 1)])
        monkeypatch.setattr(language_model, "LANE_WORDS", 10_000)
        whole = automaton.traverse(ids, lens)
        for size in (1, 2, 7, 256):
            monkeypatch.setattr(language_model, "LANE_WORDS", size)
            assert np.allclose(automaton.traverse(ids, lens), whole)


def test_probabilities_sum_to_one():
    """Over all known words and the class of unknown ones, from every state."""
    rng = np.random.default_rng(1)
    lens = np.full(40, 12)
    ids = rng.integers(1, 9, lens.sum())
    ends = np.cumsum(lens)
    ids[ends - 1] = ids[ends - lens] = 0
    n_words = 10  # word 9 does not occur and stands for the unknown
    grams = language_model.Grams(ids, lens, n_words, 3)
    counts = [grams.counts(k, np.ones(len(ids))) for k in range(3)]
    facts = language_model.Facts(int(counts[0].sum()), int((counts[0] > 0).sum()), int((counts[0] == 1).sum()), 3)
    automaton = language_model.Automaton(grams, counts, facts, [rng.uniform(0.1, 0.9, 64) for _ in range(2)])
    states = [(0, 0)] + [(k + 1, i) for k in range(2) for i in np.flatnonzero(counts[k])]
    for level, at in states:
        if level == 2 and grams.codes[1][at] % n_words == 0:
            continue  # nothing follows an end token after a word
        a, b, w = np.full(n_words, level), np.full(n_words, at), np.zeros(n_words)
        automaton.step(a, b, np.arange(n_words), w)
        assert math.isclose((10**w).sum(), 1, rel_tol=1e-9)


def test_no_training_documents_and_empty_tables(spark):
    held = next(i for i in range(100) if split(i))
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert rows_of(score(df)) == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert score(df.filter("false")).count() == 0
    nothing = spark.createDataFrame([(i, t) for i in range(8) for t in (None, "", " ")], "doc_id long, text string")
    rows = rows_of(score(nothing))
    assert len(rows) == 24 and all(r[2:5] == (1, 1, 18) for r in rows) and {r[1] for r in rows} == {False, True}
