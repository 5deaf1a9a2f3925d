import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from flowpane.llm import repeats
from flowpane.llm.repeats import LENGTH, LoserTree, common_prefix, without_repeats


def brute(raws):
    times = collections.Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if times[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 40))) for _ in range(k)]
        coded = [iter([(common_prefix(r[i - 1], x) if i else 0, (x,)) for i, x in enumerate(r)]) for r in runs]
        got = list(LoserTree(coded))
        assert [x[1][0] for x in got] == sorted(x for r in runs for x in r)
        assert all(got[i][0] == common_prefix(got[i - 1][1][0], got[i][1][0]) for i in range(1, len(got)))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_ROWS", 2)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgéñ", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(110), prose(75), prose(300)]
    texts = []
    for i in range(60):
        t = prose(rng.randint(5, 250))
        if i % 3 == 0:
            p = rng.choice(passages)
            cut = rng.randint(0, 200) if i % 2 else 0
            t += " " + p[cut:] + " " + prose(rng.randint(0, 40))
        texts.append(t)
    texts += [texts[0], texts[1][:-3] + "xyz", texts[3], "abc " * 400, "z" * 900, "y" * 400, "y" * 399, "", None, prose(9000), passages[2][100:620] + passages[2][90:700]]
    rows = [("x", i, t) for i, t in enumerate(texts)] + [("x", None, texts[5]), ("x", 7, texts[7])]
    docs = spark.createDataFrame(rows, "h string, doc_id long, text string")
    want = collections.Counter((r[1], *w) for r, w in zip(rows, brute([(r[2] or "").encode() for r in rows])))
    got = collections.Counter(tuple(r)[:-1] for r in without_repeats(docs, with_text=False).collect())
    assert got == want
    assert without_repeats(docs.filter(F.lit(False))).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in without_repeats(docs.filter("doc_id < 3")).collect()}
    assert kept[1] == texts[1].encode()


def test_splitters_between_all_contexts(spark, monkeypatch):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(900)
    texts = [prose(300) + passage + prose(200)] * 2 + [prose(100) + passage[:760] + prose(150), prose(50) + passage[130:] + prose(90), prose(500)]
    keys = set()
    for raw in (t.encode() for t in texts):
        found = repeats.anchors(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        keys |= {repeats.context(raw, int(p), int(low), int(high)) for _, p, low, high, _ in zip(*found)}
    cut = repeats._cut_batches
    monkeypatch.setattr(repeats, "_cut_batches", lambda splitters: cut(sorted(keys)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = collections.Counter(tuple(r)[1:-1] for r in without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=False).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == collections.Counter(brute([t.encode() for t in texts]))


def test_parted_neighbourhoods(monkeypatch):
    """A neighbourhood that is compared in parts puts out every window that could stand in another part."""
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n)).encode()
    right, lefts = prose(300), [prose(100), prose(100)]
    keys = sorted({repeats.context(prose(150) + lefts[i % 2] + right + prose(200), 250, 60, 190) for i in range(11)})
    rows = lambda: [(common_prefix(keys[i - 1], k) if i else 0, (k, 1, i, i, 250)) for i, k in enumerate(keys)]
    monkeypatch.setattr(repeats, "_coded_items", lambda own: iter(rows()))

    def settled(parts):
        monkeypatch.setattr(repeats, "GROUP_CONTEXTS", parts)
        out = list(repeats._merge_range([{"run": 1, "seq": 1}]))
        sure = {(r["k1"], w) for r in out if "w1" not in r for w in range(r["low"], r["high"] + 1)}
        open_ = [(r["k1"], r["low"] + i, w, r["times"]) for r in out if "w1" in r for i, w in enumerate(zip(r["w1"], r["w2"]))]
        times = collections.Counter()
        for _, _, w, n in open_:
            times[w] += n
        return sure | {(k, low) for k, low, w, _ in open_ if k is not None and times[w] > 1}

    whole = settled(10_000)
    assert whole and settled(2) == whole and settled(4) == whole
