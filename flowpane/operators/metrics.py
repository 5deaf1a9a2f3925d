"""Evaluation of predictions and scores against 0/1 labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowpane.functions import numbers as N
from flowpane.operators.ordered import null_safe_join, running_totals, value_counts
from flowpane.operators.profile import histogram
from flowpane.session import materialise


def confusion(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by, tn, fp, fn, tp)."""
    cell = lambda p, y: F.count_if((F.col(pred) == p) & (F.col(label) == y))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(1, 1).alias("tp"))


def _prf(tp, fp, fn):
    return N.ratio(tp, tp + fp), N.ratio(tp, tp + fn), N.ratio(2 * tp, 2 * tp + fp + fn)


def prf(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = (), average: str = "binary") -> DataFrame:
    """(by, accuracy, precision, recall, f1); 0 where a denominator is 0. ``macro`` averages over both classes."""
    c = confusion(df, pred, label, by)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    one = _prf(tp, fp, fn)
    if average == "macro":
        zero = _prf(tn, fn, fp)
        one = tuple((a + b) / 2 for a, b in zip(one, zero))
    return c.select(*by, N.ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    *[m.alias(n) for m, n in zip(one, ("precision", "recall", "f1"))])


def f1_at(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    return prf(df.withColumn("pred", (F.col(score) > float(threshold)).cast("int")), "pred", label)


def score_curve(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: positives and rows with it (``pos``, ``n``), with it or a higher one (``tp``,
    ``hit``), and group totals. Everything the ranking metrics need, from one pass along the scores. Rows whose label is null or
    whose score is null or NaN take no part."""
    known = F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    runs = running_totals(value_counts(df.where(known), by, score, pos=F.col(label).cast("bigint")),
                          by, [score], ["n", "pos"])
    return runs.withColumns({"tp": F.col("pos_all") - F.col("pos_cum") + F.col("pos"),
                             "hit": F.col("n_all") - F.col("n_cum") + F.col("n")})


def ranking_metrics(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by, auc_roc, average_precision, pr_auc); 0 where only one class is present.

    ROC area from average ranks; average precision as the step sum; the third as the trapezoid under the
    precision-recall curve that starts at recall 0, precision 1.
    """
    c = score_curve(df, score, label, by)
    tp, hit, pos, n = (F.col(x) for x in ("tp", "hit", "pos", "n"))
    rank = F.col("n_cum") - n + (n + 1) / 2.0
    p = F.try_divide(tp.cast("double"), hit.cast("double"))
    before = F.coalesce(F.try_divide((tp - pos).cast("double"), (hit - n).cast("double")), F.lit(1.0))
    g = c.groupBy(*by).agg(F.sum(pos * rank).alias("r"), F.sum(pos * p).alias("ap"), F.sum(pos * (p + before) / 2).alias("tr"),
                           F.max("pos_all").alias("P"), F.max("n_all").alias("A"))
    P, M = F.col("P"), F.col("A") - F.col("P")
    both = (P > 0) & (M > 0)
    over = lambda x, d: F.when(both, F.try_divide(x, d.cast("double"))).otherwise(0.0)
    return g.select(*by, over(F.col("r") - P * (P + 1) / 2.0, P * M).alias("auc_roc"),
                    over(F.col("ap"), P).alias("average_precision"), over(F.col("tr"), P).alias("pr_auc"))


def auc_roc(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "auc_roc")


def average_precision(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "average_precision")


def pr_auc(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "pr_auc")


def evaluate(df: DataFrame, score: str, threshold: float, label: str = "label") -> DataFrame:
    """One row: threshold, F1, precision, recall, ROC area, average precision."""
    r = ranking_metrics(df, score, label).first()
    return f1_at(df, score, label, threshold).select(
        F.lit(float(threshold)).alias("threshold"), "f1", "precision", "recall",
        F.lit(r["auc_roc"]).alias("auc_roc"), F.lit(r["average_precision"]).alias("auc_pr"))


def branch_metrics(val: DataFrame, test: DataFrame, branches: Sequence[str], label: str = "label") -> DataFrame:
    """(branch, threshold, f1, precision, recall, auc_roc, auc_pr): every branch at its own best val threshold."""
    from flowpane.operators.thresholds import best_f1
    tall = lambda d: d.select(label, F.explode(F.array(*[
        F.struct(F.lit(b).alias("branch"), F.col(b).cast("double").alias("score")) for b in branches])).alias("e")).select(
        label, "e.branch", "e.score")
    cuts = materialise(best_f1(tall(val), "score", label, ["branch"]).select("branch", "threshold"))
    t = tall(test)
    judged = null_safe_join(t, cuts, ["branch"]).withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))
    out = prf(judged, "pred", label, ["branch"]).join(ranking_metrics(t, "score", label, ["branch"]), "branch").join(cuts, "branch")
    return out.select("branch", "threshold", "f1", "precision", "recall", "auc_roc", F.col("average_precision").alias("auc_pr"))


def class_report(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """(class, precision, recall, f1, support) from one count per (label, prediction)."""
    cells = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col(label) == F.col(pred)
    roles = F.array(F.struct(F.col(label).alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                             F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
                    F.struct(F.col(pred).alias("class"), F.lit(0).cast("bigint").alias("tp"),
                             F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")))
    g = cells.select(F.explode(roles).alias("e")).groupBy("e.class").agg(
        F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.sum("e.fn").alias("fn"))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("class", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def confusion_from_pr(df: DataFrame) -> DataFrame:
    """Counts from ``total_positive``, ``total_negative``, ``precision`` and ``recall`` (halves round to even)."""
    tp = F.bround(F.col("recall") * F.col("total_positive")).cast("bigint")
    fp = F.bround(F.try_divide(F.col("tp"), F.col("precision")) - F.col("tp")).cast("bigint")
    return df.withColumn("tp", tp).withColumn("fp", fp).withColumns(
        {"fn": F.col("total_positive") - F.col("tp"), "tn": F.col("total_negative") - F.col("fp")})


def score_histogram(df: DataFrame, score: str, by: Sequence[str], bins: int = 45, lo: float = 0.0, hi: float = 2.0) -> DataFrame:
    return histogram(df, score, bins, by, lo, hi, density=True)


def score_kde(df: DataFrame, score: str, by: Sequence[str], points: int = 400, lo: float = 0.0, hi: float = 2.0) -> DataFrame:
    """(by, x, density): Gaussian kernel density on an even grid, Scott's bandwidth; 0 for constant or single scores.

    Equal scores are merged first. A batch of scores meets the whole grid as one matrix; only its sums leave the task, one row per
    group of the batch.
    """
    by, grid = list(by), np.linspace(lo, hi, points)
    facts = materialise(df.groupBy(*by).agg(F.count(score).alias("_n"), F.stddev_samp(score).alias("_sd")))
    usable = (F.col("_n") > 1) & (F.col("_sd") > 0)
    counts = null_safe_join(value_counts(df, by, score), facts, by).select(
        *by, F.col(score).cast("double").alias("_s"), F.col("n").cast("double").alias("_w"), F.when(usable, F.col("_sd") * F.pow(
            F.col("_n").cast("double"), F.lit(-0.2))).alias("_bw"), F.col("_n").cast("double").alias("_n"))

    def sums(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                pdf = part.to_pandas()
                code = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(pdf), int)
                s, w, bw, n = (pdf[c].to_numpy(dtype=float) for c in ("_s", "_w", "_bw", "_n"))
                bw = np.where(np.isnan(bw), np.inf, bw)  # no spread, no density
                kernels = np.exp(-0.5 * ((grid[None, :] - s[:, None]) / bw[:, None]) ** 2) * (w / (bw * n * math.sqrt(2 * math.pi)))[:, None]
                groups, first = np.unique(code, return_index=True)
                rows = pa.Table.from_batches([part]).take(pa.array(first)).select(by)
                yield from rows.append_column("_d", pa.array([kernels[code == g].sum(axis=0) for g in groups], pa.list_(pa.float64()))).to_batches()

    kinds = dict(counts.dtypes)
    parts = counts.mapInArrow(sums, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_d array<double>"]))
    x = F.lit(lo) + F.col("_i") * ((hi - lo) / (points - 1))
    return (parts.select(*by, F.posexplode("_d").alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum("_v").alias("density"))
            .select(*by, x.alias("x"), "density"))


def ecdf(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, cdf) at every distinct score."""
    runs = running_totals(value_counts(df, by, score), by, [score], ["n"])
    return runs.select(*by, score, (F.col("n_cum") / F.col("n_all")).alias("cdf"))


def sorted_by_rate(df: DataFrame, rate: str, name: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc(rate), name)).cast("bigint"))
