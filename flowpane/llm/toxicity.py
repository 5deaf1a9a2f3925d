"""Toxicity by a convolutional text classifier over hashed words, trained in numpy, with a threshold per language.

A word stands for three hashed features (itself and its first four and five letters) whose embeddings are averaged. Filters
of widths 1, 2 and 3 slide over the words, each is pooled by its maximum over the whole text, and a logistic unit scores the
maxima. Because convolution is linear in the embeddings, scoring looks up every word's filter responses, which a worker
computes once per distinct word.

The model is fitted on the driver on a bounded sample of labelled rows (``TRAIN_ROWS`` of either class, in the order of a
hash); rows whose crc32(doc_id) mod 4 is 2 are held out. A fifth of the sample calibrates the scores. The thresholds of the
languages come from counts of scores over all labelled rows that are neither held out nor fitted, so that either class counts
as often as it occurs; lang picks a threshold and never enters a score.

Defined results: a null or empty text gets the score of no words; a null doc_id is not held out; without labels of both
classes every score is 0 and nothing is rejected; a null or rare lang takes the threshold of all languages; repeated rows give
repeated results; an empty table an empty one. Of ``docs`` only doc_id, text and lang are read, of ``labels`` doc_id and toxic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.llm.common import SegmentTable, fresh_names, give_back, kept_in_worker, text_groups, text_or_empty

#: Labelled rows of either class that are fitted at most.
TRAIN_ROWS = 3_000
CUT = 0.3
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Small samples go through more epochs, up to so many steps.
LEAST_STEPS = 300
#: Texts that are calibrated at once; only memory depends on it.
CALIBRATE_TEXTS = 64
#: Texts that a worker pools at once; only memory depends on it.
POOLED_TEXTS = 64
#: Bins of scores that are counted; a cut lies between two of them.
SCORE_BINS = 1000
#: Labelled rows of either class from which a language has a threshold of its own.
OWN_THRESHOLD = 15
SEED = 7
_PAD = "\0"
_OFFSETS = [(k, j) for k in WIDTHS for j in range(k)]
_EDGES = " .,;:!?\"'()[]{}<>-–—…«»¡¿*_|#"


def features(word: str) -> tuple[int, int, int]:
    w = word.lower().strip(_EDGES)
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (w, "4" + w[:4], "5" + w[:5]))


def _words(text: str) -> list[str]:
    """The words, with a blank after the text for every word that the widest filter may reach beyond it."""
    return [*text.split(), *[_PAD] * (max(WIDTHS) - 1)]


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIMS, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = CUT

    def responses(self, feats: np.ndarray) -> np.ndarray:
        """Responses of words (rows of three features, -1 for a blank) at every place of every filter."""
        e = self.embed[feats].mean(axis=1)
        e[feats[:, 0] < 0] = 0
        return e @ np.concatenate([self.filters[k][j] for k, j in _OFFSETS], axis=1)

    def pooled(self, responses: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each run of words."""
        r = responses[at]
        starts = np.cumsum(counts) - counts
        last = np.cumsum(counts) - 1
        out, col = [], 0
        for k in WIDTHS:
            y = r[:, col : col + FILTERS].copy()
            for j in range(1, k):
                y[:-j] += r[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
                y[last - (j - 1)] = -np.inf  # would reach into the next text
            out.append(np.maximum.reduceat(y, starts, axis=0))
            col += k * FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * self.logits(pooled).astype(np.float64) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def _calibrating(toxic: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A fifth of either class, which is not fitted."""
    held = np.zeros(len(toxic), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(toxic == c))
        held[own[: len(own) // 5]] = True
    return held


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], weights: tuple[float, float] = (1.0, 1.0), seed: int = SEED) -> Model | None:
    """A model of the texts; None without both classes. ``weights``: how many rows a clean and a toxic one stand for."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    rng = np.random.default_rng(seed)
    table: dict[str, int] = {_PAD: 0}
    runs = [np.array([table.setdefault(w, len(table)) for w in _words(t)], np.int32) for t in texts]
    feats = np.full((len(table), 3), -1, np.int32)
    for i, w in enumerate(table):
        if i:
            feats[i] = features(w)
    del table  # as large as all else together
    held = _calibrating(toxic, rng)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32),
                  {k: rng.normal(0, 0.3, (k, DIMS, FILTERS)).astype(np.float32) for k in WIDTHS},
                  np.full(FILTERS * len(WIDTHS), 0.1, np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    params = {"embed": model.embed, "bias": model.bias, "out": model.out, **{k: model.filters[k] for k in WIDTHS}}
    first, second = ({n: np.zeros_like(p) for n, p in params.items()} for _ in "ab")
    step, train = 0, np.flatnonzero(~held)
    batches = max(1, len(train) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for some in np.array_split(rng.permutation(train), batches):
            step += 1
            grads = {n: np.zeros_like(p) for n, p in params.items()}
            pools, tops, done = [], [], 0
            met, inverse = np.unique(np.concatenate([runs[i] for i in some]), return_inverse=True)
            together = model.responses(feats[met])[inverse]
            for i in some:
                r, pool, top = together[done : done + len(runs[i])], [], []
                done += len(r)
                n, col = len(runs[i]), 0
                for k in WIDTHS:
                    y = sum(r[j : n - k + 1 + j, col + j * FILTERS : col + (j + 1) * FILTERS] for j in range(k))
                    top.append(y.argmax(axis=0))
                    pool.append(y.max(axis=0))
                    col += k * FILTERS
                pools.append(np.concatenate(pool))
                tops.append(np.concatenate(top))
            h = np.array(pools) + model.bias
            active = np.maximum(h, 0)
            z = np.clip(active @ model.out + model.out_bias, -30, 30)
            d = ((1 / (1 + np.exp(-z)) - toxic[some]) / len(some)).astype(np.float32)
            grads["out"] = active.T @ d + 1e-4 * model.out
            model.out_bias -= RATE * 10 * float(d.sum())
            g = d[:, None] * model.out * (h > 0)
            grads["bias"] = g.sum(axis=0)
            for row, i in enumerate(some):
                for w, k in enumerate(WIDTHS):
                    cols = slice(w * FILTERS, (w + 1) * FILTERS)
                    gr, at = g[row, cols], tops[row][cols]
                    for j in range(k):
                        f = feats[runs[i][at + j]]
                        live = f[:, 0] >= 0
                        e = model.embed[f].mean(axis=1) * live[:, None]
                        grads[k][j] += (e * gr[:, None]).T
                        back = (model.filters[k][j].T * gr[:, None] / 3)[live]
                        for c in range(3):
                            np.add.at(grads["embed"], f[live, c], back)
            for n, p in params.items():
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.01 * (grads[n] ** 2 - second[n])
                p -= RATE * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-6)
    _calibrate(model, runs, feats, toxic, np.array([x or "" for x in langs]), held, weights)
    return model


def _calibrate(model: Model, runs, feats, toxic, langs, held, weights) -> None:
    """Scale and shift of the logits by weighted logistic regression, and per language the cut of best F1."""
    own = np.flatnonzero(held) if held.any() and len(set(toxic[held])) == 2 else np.arange(len(runs))
    # the words' responses are looked up for a few texts at a time
    responses = model.responses(feats)
    pooled = np.concatenate([model.pooled(responses, np.concatenate([runs[i] for i in some]), np.array([len(runs[i]) for i in some]))
                             for some in np.split(own, range(CALIBRATE_TEXTS, len(own), CALIBRATE_TEXTS))])
    del responses
    z, y = model.logits(pooled).astype(np.float64), toxic[own]
    w = np.where(y == 1, weights[1], weights[0])
    w = w / w.sum()
    goal = np.where(y == 1, 0.995, 0.005)  # keeps the slope finite where classes part
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g, v = w * (p - goal), w * p * (1 - p) + 1e-9
        grad = np.array([g @ z + 1e-4 * (a - 1), g.sum()])
        hess = np.array([[v @ (z * z) + 1e-4, v @ z], [v @ z, v.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    model.scale, model.shift = max(a, 0.05), b
    scores = model.scores(pooled)
    model.threshold = best_cut(scores, y, w)
    for lang in set(langs[own]):
        m = langs[own] == lang
        if lang and min((y[m] == 1).sum(), (y[m] == 0).sum()) >= OWN_THRESHOLD:
            model.thresholds[lang] = best_cut(scores[m], y[m], w[m])


def best_cut(scores: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The cut of best F1, in the middle of its gap between scores. ``weights``: how many rows each stands for."""
    w = np.ones(len(y)) if weights is None else weights
    order = np.argsort(-scores)
    hits = np.cumsum((w * y)[order])
    f1 = 2 * hits / (np.cumsum(w[order]) + (w * y).sum())
    f1[:-1][scores[order][:-1] == scores[order][1:]] = -1
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((scores[order[k]] + below) / 2)


def _cut_of_bins(bins: list) -> float:
    """``best_cut`` from bins of scores, each with the number of rows and of toxic ones, its least and its greatest score."""
    bins = sorted(bins, key=lambda r: -r["at"])
    n, hits = (np.cumsum([r[x] for r in bins]) for x in ("n", "hits"))
    k = int((2 * hits / (n + hits[-1])).argmax())
    return (bins[k]["low"] + (bins[k + 1]["high"] if k + 1 < len(bins) else 0.0)) / 2


def _set_thresholds(model: Model, docs: DataFrame, given: DataFrame, fitted: list[int]) -> None:
    """Cuts of best F1 over all labelled rows of ``given`` that are not ``fitted``; those of the sample stay where a class is missing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    ids = docs.sparkSession.createDataFrame([(i,) for i in fitted], "doc_id long")
    own = given.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(ids), "doc_id", "left_anti")
    found = scored(rows, model, "score", "rejected").select("doc_id", "lang", "score").join(own, "doc_id")
    # a row for each language and bin at most
    bins = found.groupBy("lang", F.floor(F.col("score") * SCORE_BINS).alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high")).collect()

    def least(some: list) -> int:
        return min(sum(r["hits"] for r in some), sum(r["n"] - r["hits"] for r in some))

    if not least(bins):
        return
    every: dict[int, dict] = {}
    for r in bins:
        b = every.setdefault(r["at"], {"at": r["at"], "n": 0, "hits": 0, "low": r["low"], "high": r["high"]})
        b |= {"n": b["n"] + r["n"], "hits": b["hits"] + r["hits"], "low": min(b["low"], r["low"]), "high": max(b["high"], r["high"])}
    model.threshold, model.thresholds = _cut_of_bins(list(every.values())), {}
    for lang in {r["lang"] for r in bins if r["lang"]}:
        some = [r for r in bins if r["lang"] == lang]
        if least(some) >= OWN_THRESHOLD:
            model.thresholds[lang] = _cut_of_bins(some)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents of either class that are not held out; thresholds from all others."""
    given = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~_held_out())
    given = given.groupBy("doc_id").agg(F.max("y").alias("y"))  # a document with both labels is toxic
    sizes = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for y in (0, 1):
        some = given.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        sample = some if sample is None else sample.union(some)
    # at most 2 * rows ids, and of the rows that share one the first by text and language
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang")).alias("r"))
             .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("r").alias("r")).select("doc_id", "y", "r.*").orderBy("doc_id").collect())
    y = np.array([r["y"] for r in found], np.int64)
    weights = tuple(sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1))
    model = fit([r["text"] for r in found], y, [r["lang"] for r in found], weights)
    give_back()  # the driver goes on for long
    if model is not None:
        held = _calibrating(y, np.random.default_rng(SEED))
        _set_thresholds(model, docs, given, [r["doc_id"] for r, h in zip(found, held, strict=True) if not h])
    return model


def _score_batches(model: Model | None, score: str):
    """Every batch with the score of its last column, the text, after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values_of(words: list[str]):
            rows = np.array([(-1, -1, -1) if w == _PAD else features(w) for w in words], np.int32)
            return np.full(len(words), 3), rows.ravel()
        kept_in_worker("toxicity", dict)  # what other operators kept is not needed now
        table, held, done = SegmentTable(values_of, np.int32, 250_000), np.zeros((1 << 16, FILTERS * len(_OFFSETS)), np.float32), 0
        for batch in batches:
            for start, texts in text_groups(batch.columns[-1].fill_null(""), 1_000_000):
                scores = np.zeros(len(texts))
                if model is not None:
                    at, counts = table.numbers([_words(t) for t in texts])
                    n = len(table.index)
                    if table.dropped:
                        done, table.dropped = 0, False
                    if n > len(held):
                        held = np.concatenate([held, np.zeros((n, held.shape[1]), np.float32)])
                    held[done:n] = model.responses(table.ragged.flat[3 * done : 3 * n].reshape(-1, 3))
                    done = n
                    ends = np.cumsum(counts)
                    scores = model.scores(np.concatenate([
                        model.pooled(held, at[ends[a] - counts[a] : ends[b]], counts[a : b + 1])
                        for a in range(0, len(texts), POOLED_TEXTS) for b in [min(a + POOLED_TEXTS, len(texts)) - 1]]))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(scores)], names=[*batch.schema.names, score])
    return run


def scored(docs: DataFrame, model: Model | None, score: str, rejected: str) -> DataFrame:
    """``docs`` with the columns ``score`` and ``rejected`` (the score reaches its language's threshold). The text goes to Python once."""
    kept = [c for c in docs.columns if c not in (score, rejected)]
    rows = docs.select(*[c for c in kept if c != "text"], F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score_batches(model, score), rows.withColumn(score, F.lit(0.0)).schema)
    cut = F.lit(2.0 if model is None else model.threshold)
    for lang, own in sorted(model.thresholds.items()) if model else ():
        cut = F.when(F.col("lang") == lang, own).otherwise(cut)
    return out.withColumn(rejected, F.col(score) >= cut).select(*kept, score, rejected)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, whatever those are called."""
    score, rejected = fresh_names(docs, "score", "rejected")
    return scored(docs, train(docs, labels), score, rejected).filter(~F.col(rejected)).drop(score, rejected)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, "score", "rejected").select("doc_id", _held_out().alias("held_out"), "score",
                                                           (F.col("score") >= CUT).cast("int").alias("predicted"), "rejected")
