import collections
import random
import re

import corpus_pipeline
from flowpane.llm import simhash
from flowpane.llm.common import stage
from flowpane.llm.vocab import byte_encoding


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(6)
    syllables = ["th", "on", "er", "ing", "ea", "st", "ti", "re", "an", "ble"]
    rows, labels = [], []
    for i in range(700):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(120, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]))
        text = " ".join(words)
        if i % 9 == 4:
            text += f" mail a.b{i}@mail.example.com"
        rows.append((i, text, "en", f"s{i % 5 if i % 5 else rng.randint(0, 4)}", len(text)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s1", rows[i][4]) for i in range(1, 40)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    toxic = {r[0] for r in rows if r[1] and re.search("idiot|scum", r[1])}
    assert len(ids["toxicity"] ^ ({r[0] for r in rows} - toxic)) <= 8
    clean = {r["doc_id"]: r["text"] for r in kept["toxicity"]}
    first = {}
    for i in sorted(clean):
        first.setdefault(clean[i] or "", i)
    assert ids["simhash_near_dedup"] == set(first.values())
    assert not any(re.search("@", r["text"] or "") for r in kept["personal_data"]) and ids["personal_data"] == ids["simhash_near_dedup"]
    text = {r["doc_id"]: r["text"] for r in kept["personal_data"]}
    times = collections.Counter(r["doc_id"] for r in kept["mixing"])
    assert set(times) == ids["personal_data"] and max(times.values()) <= 2
    assert all(r["text"] == text[r["doc_id"]] for r in kept["mixing"])
    assert sorted((r["doc_id"], r["ids"]) for r in kept["byte_bpe"]) == sorted(
        (r["doc_id"], byte_encoding().encode_ordinary(r["text"] or "")) for r in kept["mixing"])


def test_near_copies_without_broadcast_keys(spark, monkeypatch):
    plans = {}

    def seen(df, name="stage"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)
    monkeypatch.setattr(simhash, "stage", seen)
    docs = spark.createDataFrame([(i, f"a b c d {i // 2}") for i in range(40)], "doc_id long, text string")
    ids = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert ids and ids <= set(range(0, 40, 2))
    # the keys, 67 rows for each fingerprint, look as small as the fingerprints before they are made
    assert "Generate" in plans["pairs"] and "Broadcast" not in plans["pairs"]
