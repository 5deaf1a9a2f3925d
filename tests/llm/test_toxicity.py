import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowpane.llm import toxicity
from flowpane.llm.toxicity import _words, best_cut, features, fit, keep_clean, scored, train


def made(n, seed, bad=("idiot", "scum", "lowei")):
    rng = random.Random(seed)
    syllables = ["th", "on", "er", "ing", "ea", "st", "ti", "re", "an", "ble"]
    texts, toxic = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 200))]
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            for _ in range(5):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words) + 1), w + rng.choice(syllables) if w == "lowei" else w + rng.choice([".", ",", ""]))
        texts.append(" ".join(words))
    return texts, np.array(toxic)


def test_held_out_accuracy_and_pooling():
    texts, toxic = made(900, 1)
    model = fit(texts, toxic, ["en"] * len(texts))
    new, y = made(400, 2)
    index = {}
    runs = [np.array([index.setdefault(w, len(index)) for w in _words(t)]) for t in new]
    feats = np.array([(-1, -1, -1) if w == "\0" else features(w) for w in index])
    pooled = model.pooled(model.responses(feats), np.concatenate(runs), np.array([len(r) for r in runs]))
    for r, row in zip(runs[:40], pooled):  # against sliding filters over the words themselves
        e = model.embed[feats[r]].mean(axis=1) * (feats[r][:, :1] >= 0)
        for w, k in enumerate((1, 2, 3)):
            at = [sum(e[i + j] @ model.filters[k][j] for j in range(k)) for i in range(len(r) - k + 1)]
            assert np.allclose(np.max(at, axis=0), row[8 * w : 8 * w + 8], atol=1e-4)
    scores = model.scores(pooled)
    assert ((scores >= 0.3) == y).mean() > 0.98
    assert ((scores >= model.thresholds["en"]) == y).mean() > 0.98
    assert best_cut(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0])) == 0.45


def test_documents(spark):
    texts, toxic = made(500, 3)
    rows = [("x", i, t, "en", 1) for i, t in enumerate(texts)] + [("x", 1000, None, None, 1), ("x", 1001, "", "zz", 1), ("x", None, texts[0], "en", 1), ("x", 1002, "plain " * 30000, "en", 1)]
    docs = spark.createDataFrame(rows, "score string, doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(i, int(y), 1) for i, y in enumerate(toxic)] + [(3, None, 1), (None, 1, 1), (0, 1, 1)], "doc_id long, toxic int, quality int")
    model = train(docs, labels)
    got = {r["doc_id"]: r for r in scored(docs, model, "__toxicity", "__rejected").collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i]["__toxicity"] >= 0.3) == toxic[i] for i in held]) > 0.97
    assert not got[1000]["__rejected"] and not got[1002]["__rejected"] and got[None]["__rejected"]
    clean = keep_clean(docs, labels)
    assert clean.columns == docs.columns and 380 < clean.count() < 440
    none = train(docs, labels.filter("toxic = 0"))
    assert none is None and scored(docs, none, "__toxicity", "__rejected").filter("__toxicity <> 0 OR __rejected").count() == 0
    assert scored(docs.filter(F.lit(False)), model, "a", "b").count() == 0


def test_thresholds_come_from_the_natural_mix(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 9 == 0
        words = ["".join(rng.choices(["th", "on", "er", "ing", "ea"], k=2)) for _ in range(30)]
        # a word in three tenths of the toxic texts and in a tenth of the clean ones: most texts that have it are clean
        word = ("meh" if rng.random() < 0.3 else "idiot") if toxic else "meh" if rng.random() < 0.1 else "calm"
        for _ in range(3):
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["__rejected"] for r in scored(docs, train(docs, labels, 100), "__toxicity", "__rejected").collect()}
    meh = np.mean([got[i] for i, t, _ in rows if "meh" in t])
    assert meh < 0.5, meh
    assert np.mean([got[i] for i, t, _ in rows if "idiot" in t]) > 0.9


def test_copies_of_one_document_leave_the_others_in_the_sample(spark):
    """Thousands of rows of one labelled document are one row of the sample; a document with both labels is toxic; any column name stays."""
    good, bad = "calm river stones under quiet trees", "vile filth rotten scum stupid trash"
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    rows = [(i, bad if i % 4 == 0 else good, "en", 1) for i in ids] + [(ids[1], good, "en", 2)] * 6100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumns({"__rejected": F.lit("r"), "__toxicity": F.lit("t")})
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids] + [(ids[0], 0), (ids[0], 1)], "doc_id long, toxic int")
    model = train(docs, labels, 3000)
    assert model is not None
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 4 = 0").count() == 0 and kept.count() == len([i for i in ids if i % 4]) + 6100


def test_calibration_looks_up_few_texts_at_once(monkeypatch):
    met, pooled = [], toxicity.Model.pooled
    monkeypatch.setattr(toxicity.Model, "pooled", lambda m, r, at, counts: met.append(len(counts)) or pooled(m, r, at, counts))
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    texts, toxic = made(900, 5)
    model = fit(texts, toxic, ["en"] * len(texts))
    assert sum(met) == 180 and max(met) <= toxicity.CALIBRATE_TEXTS  # a fifth calibrates
    monkeypatch.setattr(toxicity, "CALIBRATE_TEXTS", 1000)
    once = fit(texts, toxic, ["en"] * len(texts))
    assert (model.scale, model.shift, model.threshold, model.thresholds) == (once.scale, once.shift, once.threshold, once.thresholds)


def test_a_worker_pools_few_texts_at_once(monkeypatch):
    texts, toxic = made(300, 4)
    model = fit(texts, toxic, ["en"] * len(texts))
    pooled, sizes = toxicity.Model.pooled, []
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array([*texts, "", None])], names=["doc_id", "text"])
    monkeypatch.setattr(toxicity.Model, "pooled", lambda self, held, at, counts: sizes.append(len(counts)) or pooled(self, held, at, counts))
    few = pa.Table.from_batches(toxicity._score_batches(model, "score")(iter([batch])))
    assert max(sizes) <= 64 and sum(sizes) == 302
    monkeypatch.setattr(toxicity, "POOLED_TEXTS", 1000)
    assert few.equals(pa.Table.from_batches(toxicity._score_batches(model, "score")(iter([batch]))))
