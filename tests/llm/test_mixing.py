import collections
import math

from pyspark.sql import functions as F

from flowpane.llm.mixing import find_power, mix


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy string, size int")


def test_budgets_weights_and_blocks(spark):
    rows = [(i, "word " * (5 + i % 7), f"s{min(i % 30, 3)}", "x", 1) for i in range(3000)]
    got = mix(docs_of(spark, rows), repetition_limit=2.0, block_tokens=2000).collect()
    size = collections.Counter()
    for r in rows:
        size[r[2]] += r[1].count(" ") + 1
    top = max(size.values())
    small = min(size.values())
    power = 1 - math.log(2) / math.log(top / small)
    out, copies = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in got:
        out[r["source"]] += r["text"].count(" ") + 1
        copies[r["source"]][r["doc_id"]] += 1
    for s, n in size.items():
        assert abs(out[s] - n * (top / n) ** (1 - power)) <= 12
        assert len(copies[s]) == sum(r[2] == s for r in rows) and max(copies[s].values()) - min(copies[s].values()) <= 1
    blocks = collections.defaultdict(collections.Counter)
    for r in got:
        blocks[r["mix_block"]][r["source"]] += r["text"].count(" ") + 1
    total = sum(out.values())
    for b in list(blocks)[:-1]:
        if b < max(blocks):
            for s in out:
                assert abs(blocks[b][s] - 2000 * out[s] / total) <= 13
    for s in out:
        mine = sorted((r["mix_place"], r["text"].count(" ") + 1) for r in got if r["source"] == s)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))


def test_power_for_an_entropy(spark):
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "__source string, share double").withColumn("top", F.lit(0.7))
    a = find_power(shares, None, entropy=1.0)
    w = [p ** a for p in (0.7, 0.2, 0.1)]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.0) < 1e-9


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b", "s", "x", 1), (2, "", "s", "x", 1), (3, "c d e", "", "x", 1), (3, "c d e", "", "x", 1), (4, None, "t", "q", 0),
            (5, "long " * 50000, "s", "x", 1)]
    got = mix(docs_of(spark, rows), repetition_limit=1.0)
    assert got.columns == ["doc_id", "text", "source", "size", "mix_copy", "mix_block", "mix_place"]
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "3", "3", "4", "5", "None"]
    assert mix(docs_of(spark, [])).count() == 0
