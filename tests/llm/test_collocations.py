import random
import re
from collections import Counter, defaultdict

import numpy as np

from flowpane.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=10, top=2000):
    """All n-grams counted in dictionaries, every candidate against every longer one that holds it."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made(seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "É", "zu", "a-b", "x y", "ZZ", "\x00", "w1", "w2", "w3", "w4"]
    text = lambda k: "".join(rng.choices(words, [9, 7, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b"]) for _ in range(k))
    docs = [(rng.choice(["en", "en", "de", None, "und", ""]), text(rng.randint(0, 40))) for _ in range(250)]
    return docs + [("en", "one two three")] * 30 + [("en", "one two")] * 20 + [("fr", "only once here"), ("en", None), ("en", ""), ("de", "the the the " * 400)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, docs):
    return spark.createDataFrame([("p", lang, t, 1) for lang, t in docs], "phrase string, lang string, text string, n int").repartition(4)


def test_against_plain_counts(spark, monkeypatch):
    """Several shards a partition and many prefix ranges, which part the words and pairs of frequent first words."""
    monkeypatch.setattr(C, "SHARD_BYTES", 3000)
    monkeypatch.setattr(C, "RANGE_GRAMS", 400)
    monkeypatch.setattr(C, "SAMPLE_STEP", 10)
    docs = made()
    shards = frame(spark, docs)
    got = rows_of(C.collocations(shards))
    assert got == plain(docs) and len(got) > 60
    assert rows_of(C.collocations(shards, top=3)) == plain(docs, top=3)


def test_one_range_and_empty_tables(spark):
    docs = made(9)
    assert rows_of(C.collocations(frame(spark, docs))) == plain(docs)
    assert C.collocations(frame(spark, docs).filter("false")).count() == 0
    assert rows_of(C.collocations(frame(spark, [("en", "a b")]))) == []


def test_transducers():
    """Bytes and back, shared states, union, cuts and composition."""
    rng = np.random.default_rng(3)
    words = [bytes([97 + i // 5, 97 + i % 5]) for i in range(25)]
    make = lambda n: C.Grams.count(words, np.concatenate([np.arange(25), [-1], np.where(rng.random(n) < 0.1, -1, rng.integers(0, 25, n) % 11)]))

    def paths(g):
        one = {(g.words[w],): int(f) for w, f in zip(g.one, g.f1) if f}
        two = {(g.words[g.one[a]], g.words[b]): int(f) for a, b, f in zip(g.of_one, g.two, g.f2)}
        keys = [(g.words[g.one[a]], g.words[b]) for a, b in zip(g.of_one, g.two)]
        return one | two | {(*keys[a], g.words[b]): int(f) for a, b, f in zip(g.of_two, g.three, g.f3)}

    a, b = make(400), make(300)
    assert paths(C.Grams.from_bytes(a.to_bytes())) == paths(a)
    total = Counter(paths(a)) + Counter(paths(b))
    both = C.Grams.union([a, b])
    assert paths(both) == total
    assert {k: v for k, v in paths(both.prune(5)).items()} == {k: v for k, v in total.items() if v >= 5}
    splitters = [(b"aa", b"ac"), (b"aa", b"bb"), (b"ab", b""), (b"b", b"zz"), (b"zz", b"a")]
    pieces = [paths(p) for p in both.cut(splitters)]
    assert sum(map(len, pieces)) == len(total) and {k: v for p in pieces for k, v in p.items()} == total
    for i, piece in enumerate(pieces):
        for k in piece:
            assert (i == 0 or k >= splitters[i - 1]) and (i == len(splitters) or k < splitters[i])
    asked = both.prune(4).parts()
    f1, f2 = both.compose(asked)
    assert [total[(asked.words[w],)] for w in asked.one] == f1.tolist()
    assert [total[(asked.words[x], asked.words[y])] for x, y in zip(asked.first(), asked.two)] == f2.tolist()
    repeated = C.Grams.count(words[:3], np.array([0, 1, -1, 2, 1, -1]))
    states = C._closed(np.array([0, 1, 1, 2]), np.array([1, 1]), np.array([1, 1]))[0]
    assert states[0] == states[2] != states[1] and repeated.size == 5


def test_large_counts_are_exact():
    assert C.worst_cut(3 * 10**9, [(3 * 10**9, 4 * 10**9), (9 * 10**9, 10**10)])[0] == 10**6 * 9 * 10**18 // (9 * 10**19)
    assert C.worst_cut(10, [(20, 30), (30, 20)])[1:] == (20, 30)
