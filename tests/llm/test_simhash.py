import random

import xxhash
from pyspark.sql import functions as F

from flowpane.llm.components import components
from flowpane.llm.simhash import fingerprint, keep_one, links, near_duplicates


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 20000]:
        text = " ".join(rng.choice(["Ab", "é", "XYZ", "the", "\tq", "Ñu\xa0x"]) + str(rng.randint(0, 9)) for _ in range(n))
        assert fingerprint(text) == brute(text)


def test_hash_is_that_of_spark(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("the cat sat")).alias("h")).first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("the cat sat", 42)


def test_links_against_all_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    values = set(base)
    for x in base:
        for k in (1, 1, 2, 2, 2, 3, 3):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            values.add(y)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = [(r["a"], r["b"]) for r in links(spark.createDataFrame([(v,) for v in signed], "print long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_exploded_keys_stay_with_the_executors(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.getrandbits(63)) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, print long").write.parquet(str(tmp_path / "prints"))
    met = links(spark.read.parquet(str(tmp_path / "prints")).select("print"))
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_path(spark):
    rng = random.Random(3)
    names = rng.sample(range(10000), 300)
    pairs = list(zip(names, names[1:])) + [(20000, 20001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: min(names) for n in names} | {20000: 20000, 20001: 20000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        own = rng.choices(words, k=300)
        texts.append(" ".join(own))
        for _ in range(4):
            near = list(own)
            near[rng.randrange(300)] = "changed"
            texts.append(" ".join(near))
    texts += ["", None, " \n", "one two", "One  TWO", "long " * 20000]
    rows = [("p", i + 10, t, 1) for i, t in enumerate(texts)] + [("q", None, "no id here at all", 2), ("q", 3, "one two", 2), ("q", 3, "one two", 2)]
    docs = spark.createDataFrame(rows, "print string, doc_id long, text string, root int")
    got = near_duplicates(docs).collect()
    prints = [brute(r[2] or "") for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        known = [x for x in (least.get(top(i)), r[1]) if x is not None]
        least[top(i)] = min(known) if known else None
    key = lambda x: tuple(map(str, x))
    want = sorted([(r[1], f"{prints[i]:016x}", least[top(i)]) for i, r in enumerate(rows)], key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({w[2] for w in want if w[2] is not None}) and ids.count(None) == 1
    assert near_duplicates(docs.filter(F.lit(False))).count() == 0
