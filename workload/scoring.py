"""Queries over scores, thresholds, evaluation and importances."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpane.operators import attacks as T
from flowpane.operators import drift as I
from flowpane.operators import forest
from flowpane.operators import importance as M
from flowpane.operators import metrics as E
from flowpane.operators import models
from flowpane.operators import scores as J
from flowpane.operators import series as D
from flowpane.operators import splits as X
from flowpane.operators import thresholds as K
from flowpane.operators import window_features as G
from flowpane.operators import windows as win
from flowpane.session import materialise
from workload.drifting import BAND_SQL, SER_SPLIT_SQL, spectra, split_series
from workload.inputs import FEATURES, META_SQL, SPEC, SPLIT_SQL, WIN_SQL, flows, positioned, query, table
from workload.shaping import HYBRID_SQL, SERIES_SQL, W_SQL, sma_sql
from workload.splitting import rounded, with_labels, with_meta

KEY = ["source", "window_id"]

# every line item is a scored row: the price is the score, a returned item is an anomaly
LINES = """ls AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'val' ELSE 'test' END AS split, l_extendedprice AS price,
  l_quantity * (1 - l_discount) AS net, l_tax AS tax, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  l_returnflag, l_linestatus FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "val").otherwise("test").alias("split"), F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_returnflag", "l_linestatus")


# ---- scores ------------------------------------------------------------------------------------------------------

@query("reconstruction_score", "J1", f"""WITH {WIN_SQL},
ser AS (SELECT source, window_id, woff AS t, 'value' AS channel, value AS x FROM win UNION ALL SELECT source, window_id, woff, 'k', k FROM win),
s AS (SELECT *, {sma_sql(25)} FROM ser {W_SQL})
SELECT source, window_id, round(avg(pow(x - y, 2)), 5) AS recon_score FROM s GROUP BY source, window_id""")
def _(spark, sf):
    s = D.sma(win.window_series(positioned(spark, sf).drop("label"), SPEC, FEATURES))
    return rounded(J.recon_score(s, F.col("trend"), KEY), 5)


@query("reconstruction_score_hybrid", "J1 H9", f"""WITH {SERIES_SQL}, {HYBRID_SQL}
SELECT source, window_id, round(avg(pow(d - y, 2)), 5) AS recon_score FROM inv JOIN rest USING (source, window_id, channel, t) GROUP BY source, window_id""")
def _(spark, sf):
    s = D.decompose(win.window_series(positioned(spark, sf).drop("label"), SPEC, FEATURES))
    return rounded(J.residual_score(s, KEY), 5)


FREQ_SQL = SER_SPLIT_SQL + """,
amps AS (SELECT split, is_malicious, source, window_id, feature AS channel, b AS bin,
  round(ln(1 + sqrt(pow(sum(value * cos(2 * pi() * ((b * t) % 100) / 100)), 2) + pow(sum(value * sin(2 * pi() * ((b * t) % 100) / 100)), 2))), 7) AS amp
  FROM wtall, (SELECT unnest(range(51)) AS b) GROUP BY ALL),
base AS (SELECT channel, bin, avg(amp) AS m, var_pop(amp) AS v FROM amps WHERE split = 'train' AND is_malicious = 0 GROUP BY ALL),
err AS (SELECT a.*, pow(amp - m, 2) AS e, v FROM amps a JOIN base USING (channel, bin) WHERE bin > 0)"""


@query("frequency_score", "J2", f"""WITH {FREQ_SQL}
SELECT source, window_id, round(sum(e + 2 * greatest(e - v, 0)) / (count(*) + 1e-8), 6) AS freq_score FROM err GROUP BY ALL""")
def _(spark, sf):
    s = materialise(spectra(spark, sf).drop("x"))
    base = J.spectral_baseline(s.where("split = 'train' and is_malicious = 0"))
    return rounded(J.freq_score(s, base, KEY))


@query("band_weighted_frequency_score", "J3", f"""WITH {FREQ_SQL}
SELECT source, window_id, round(sum(e * ({BAND_SQL})) / (count(*) + 1e-8), 6) AS freq_score FROM err GROUP BY ALL""")
def _(spark, sf):
    s = materialise(spectra(spark, sf).drop("x"))
    base = J.spectral_baseline(s.where("split = 'train' and is_malicious = 0"))
    return rounded(J.freq_score(s, base, KEY, weight=lambda b: I.band_weight(b, 51)))


RANK = "(rank() OVER (PARTITION BY split ORDER BY {c}) + (count(*) OVER (PARTITION BY split, {c}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY split) - 1)"


@query("normalised_ranks", "J4", f"""WITH {LINES}, r AS (SELECT split, tax, {RANK.format(c='tax')} AS r FROM ls)
SELECT split, tax, count(*) AS n, round(max(r), 7) AS tax_rank FROM r GROUP BY split, tax""")
def _(spark, sf):
    r = J.rank_norm(lines(spark, sf), "tax")
    return r.groupBy("split", "tax").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("tax_rank"), 7).alias("tax_rank"))


@query("rank_fusion", "J5", f"""WITH {LINES}, r AS (SELECT split, price, tax, label, {RANK.format(c='price')} + {RANK.format(c='tax')} AS f FROM ls)
SELECT split, price, tax, label, round(f, 7) AS fused_score FROM r""")
def _(spark, sf):
    f = J.rank_fuse(lines(spark, sf), ["price", "tax"])
    return f.select("split", "price", "tax", "label", F.round("fused_score", 7).alias("fused_score"))


@query("zscore_fusion", "J10", f"""WITH {LINES}, b AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(tax) AS mt,
stddev_pop(tax) AS st FROM ls WHERE split = 'val' AND label = 0)
SELECT split, price, tax, label, round((price - mp) / (sp + 1e-8) + (tax - mt) / (st + 1e-8), 5) + 0.0 AS fused_score FROM ls, b""")
def _(spark, sf):
    d = lines(spark, sf)
    f = J.zscore_fuse(d, ["price", "tax"], d.where("split = 'val' and label = 0"))
    return f.select("split", "price", "tax", "label", (F.round("fused_score", 5) + 0.0).alias("fused_score"))


def stat_rows(spark, sf):
    """Window statistics with label and split, for the models."""
    pos = positioned(spark, sf)
    sizes = materialise(win.source_sizes(pos, SPEC))
    stats = G.window_stats(pos, SPEC, FEATURES)
    labels = win.window_labels(pos, SPEC).select(*KEY, F.col("is_malicious").alias("label"))
    d = win.integrate(stats.join(labels, KEY), sizes, SPEC)
    return materialise(X.split_chrono(d, X.total_windows(sizes)))


STAT_COLS = [f"{f}_{s}" for s in ("mean", "std", "max", "min") for f in FEATURES]


@query("isolation_forest_scores", "J6")
def _(spark, sf):
    d = stat_rows(spark, sf)
    fit = d.where("split = 'train' and label = 0")
    scaler = G.fit_scaler(fit, STAT_COLS)
    nodes = forest.iforest_fit(G.apply_scaler(fit, scaler), STAT_COLS, "global_window_id", trees=100, sample=256, seed=42)
    return forest.iforest_score(G.apply_scaler(d, scaler), STAT_COLS, nodes).select(*KEY, "split", "label", "score")


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_rows(spark, sf):
    return table(spark, sf, "lineitem").withColumns({
        "label": (F.col("l_returnflag") == "R").cast("int"),
        "key": F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})


@query("random_forest_windows", "J7")
def _(spark, sf):
    d = stat_rows(spark, sf)
    return models.rf_classify(d.where("split = 'train'"), d.where("split <> 'train'"), STAT_COLS, trees=20, depth=5).select(
        *KEY, "split", "label", "prob", "pred")


@query("linear_svm_windows", "J8")
def _(spark, sf):
    d = stat_rows(spark, sf)
    return models.svm_classify(d.where("split = 'train'"), d.where("split <> 'train'"), STAT_COLS, iterations=20).select(
        *KEY, "split", "label", "prob", "pred")


@query("perceptron_windows", "J9 G3")
def _(spark, sf):
    pos = positioned(spark, sf)
    sizes = materialise(win.source_sizes(pos, SPEC))
    v = G.window_vector(pos, SPEC, FEATURES).join(
        win.window_labels(pos, SPEC).select(*KEY, F.col("is_malicious").alias("label")), KEY)
    d = materialise(X.split_chrono(win.integrate(v, sizes, SPEC), X.total_windows(sizes)))
    out = models.mlp_classify(d.where("split = 'train'"), d.where("split <> 'train'"), "x", 200, hidden=(32, 16), iterations=20)
    return out.select(*KEY, "split", "label", "prob", "pred")


# ---- thresholds --------------------------------------------------------------------------------------------------

@query("percentile_thresholds", "K1", f"""WITH {LINES}, q AS (SELECT split, unnest([80.0, 95.0, 99.0]) AS percent,
  unnest(quantile_cont(price, [0.80, 0.95, 0.99])) AS threshold FROM ls GROUP BY split)
SELECT split, CAST(percent AS DOUBLE) AS percent, round(threshold, 5) AS threshold FROM q""")
def _(spark, sf):
    return rounded(K.threshold_percentile(lines(spark, sf), "price", [80, 95, 99], ["split"]), 5)


def best_sql(grid, src="ls", by="split", score="price"):
    """Brute force over a grid table (by, i, t)."""
    return f"""f1 AS (SELECT g.{by}, g.i, g.t, count(*) FILTER (s.{score} > g.t AND label = 1) AS tp, count(*) FILTER (s.{score} > g.t) AS hit,
      count(*) FILTER (label = 1) AS actual FROM {grid} g JOIN {src} s ON g.{by} = s.{by} GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY 2.0 * tp / (hit + actual) DESC, i) AS rn FROM f1) WHERE rn = 1)"""


GRID_SQL = """rng AS (SELECT split, min(price) AS lo, max(price) AS hi FROM ls GROUP BY split),
grid AS (SELECT split, i, CASE WHEN i = {n} THEN hi ELSE i * ((hi - lo) / {n}) + lo END AS t FROM rng, (SELECT unnest(range({n} + 1)) AS i))"""
PICK_SQL = """split, round(t, 5) AS threshold, round(2.0 * tp / (hit + actual), 6) AS f1_star, round(tp / hit, 6) AS precision,
  round(tp / actual, 6) AS recall"""


@query("best_f1_grid", "K2", f"""WITH {LINES}, {GRID_SQL.format(n=999)}, {best_sql('grid')} SELECT {PICK_SQL} FROM best""")
def _(spark, sf):
    b = K.best_f1(lines(spark, sf), "price", by=["split"])
    return rounded(b.withColumn("threshold", F.round("threshold", 5)))


@query("best_f1_percentile_grid", "K3", f"""WITH {LINES}, pg AS (SELECT split, unnest(range(100)) AS i,
  unnest(quantile_cont(price, [{', '.join(repr(float(p) / 100) for p in __import__('numpy').linspace(50, 99.9, 100))}])) AS t FROM ls GROUP BY split),
{best_sql('pg')} SELECT {PICK_SQL} FROM best""")
def _(spark, sf):
    b = K.best_f1_percentile(lines(spark, sf), "price", by=["split"])
    return rounded(b.withColumn("threshold", F.round("threshold", 5)))


@query("best_f1_tied_scores", "K2", f"""WITH {LINES}, {GRID_SQL.format(n=49).replace('price', 'tax')},
{best_sql('grid', score='tax')} SELECT {PICK_SQL} FROM best""")
def _(spark, sf):
    return rounded(K.best_f1(lines(spark, sf), "tax", by=["split"], n_steps=50))


@query("pot_threshold_moments", "K4", f"""WITH {LINES}, t AS (SELECT quantile_cont(price, 0.98) AS t, max(price) AS top, count(*) AS n FROM ls),
y AS (SELECT price - t AS y FROM ls, t WHERE price > t), s AS (SELECT avg(y) AS m, var_samp(y) AS v, count(*) AS k FROM y),
p AS (SELECT least(0.5 * (1 - m * m / v), 1.0) AS xi, 0.5 * m * (m * m / v + 1) AS sigma, k FROM s)
SELECT round(least(t + sigma / xi * (pow(k / (n * 1e-4), xi) - 1), top * 3), 4) AS threshold, round(t, 4) AS initial,
  round(xi, 6) AS xi, round(sigma, 4) AS sigma, k AS exceedances, n FROM t, p""")
def _(spark, sf):
    p = K.pot_threshold(lines(spark, sf), "price", fit="moments")
    return p.select(*[F.round(c, 4).alias(c) for c in ("threshold", "initial", "sigma")], F.round("xi", 6).alias("xi"),
                    "exceedances", "n")


@query("pot_threshold_likelihood", "K4")
def _(spark, sf):
    return K.pot_threshold(table(spark, sf, "events"), "value")


@query("threshold_transfer", "K5", f"""WITH {LINES}, {GRID_SQL.format(n=199)}, {best_sql('grid')},
v AS (SELECT * FROM best WHERE split = 'val'), o AS (SELECT * FROM best WHERE split = 'test'),
d AS (SELECT 2.0 * count(*) FILTER (price > t AND label = 1) / (count(*) FILTER (price > t) + count(*) FILTER (label = 1)) AS f
  FROM ls, (SELECT t FROM v) WHERE ls.split = 'test')
SELECT round(v.t, 5) AS threshold_val, round(f, 6) AS f1_test, round(o.t, 5) AS threshold_test,
  round(2.0 * o.tp / (o.hit + o.actual), 6) AS f1_star, round(2.0 * o.tp / (o.hit + o.actual) - f, 6) + 0.0 AS delta FROM v, o, d""")
def _(spark, sf):
    d = lines(spark, sf)
    t = K.threshold_transfer(d.where("split = 'val'"), d.where("split = 'test'"), "price", n_steps=200)
    t = t.withColumns({"threshold_val": F.round("threshold_val", 5), "threshold_test": F.round("threshold_test", 5)})
    return rounded(t).withColumn("delta", F.col("delta") + 0.0)


# ---- evaluation --------------------------------------------------------------------------------------------------

CM_SQL = LINES + """, pr AS (SELECT *, CAST(price > 60000 AS INTEGER) AS pred FROM ls),
cm AS (SELECT split, count(*) FILTER (pred = 0 AND label = 0) AS tn, count(*) FILTER (pred = 1 AND label = 0) AS fp,
  count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 1 AND label = 1) AS tp FROM pr GROUP BY split)"""


def judged(spark, sf):
    return K.predict(lines(spark, sf), "price", F.lit(60000.0))


@query("confusion_matrix", "L1", f"WITH {CM_SQL} SELECT * FROM cm")
def _(spark, sf):
    return E.confusion(judged(spark, sf), by=["split"])


@query("precision_recall_f1", "L2", f"""WITH {CM_SQL} SELECT split, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cm""")
def _(spark, sf):
    return rounded(E.prf(judged(spark, sf), by=["split"]))


@query("precision_recall_f1_macro", "L2", f"""WITH {CM_SQL} SELECT split, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) AS precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS recall,
round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1 FROM cm""")
def _(spark, sf):
    return rounded(E.prf(judged(spark, sf), by=["split"], average="macro"))


def curve_sql(score):
    return f"""cv AS (SELECT split, {score} AS s, count(*) AS n, sum(label) AS pos FROM ls GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS hit, sum(pos) OVER (PARTITION BY split) AS p,
      sum(n) OVER (PARTITION BY split) AS a, sum(n) OVER (PARTITION BY split ORDER BY s) AS below FROM cv
      WINDOW w AS (PARTITION BY split ORDER BY s DESC))"""


AUC = "round((sum(pos * (below - n + (n + 1) / 2.0)) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(a) - max(p))), 7) AS auc_roc"
AP = "round(sum(pos * tp / hit) / max(p), 7) AS average_precision"
PR = "round(sum(pos * (tp / hit + CASE WHEN hit = n THEN 1 ELSE (tp - pos) / (hit - n) END) / 2) / max(p), 7) AS pr_auc"


@query("roc_auc", "L3", f"WITH {LINES}, {curve_sql('tax')} SELECT split, {AUC} FROM c GROUP BY split")
def _(spark, sf):
    return rounded(E.auc_roc(lines(spark, sf), "tax", by=["split"]), 7)


@query("average_precision", "L4", f"WITH {LINES}, {curve_sql('price')} SELECT split, {AP} FROM c GROUP BY split")
def _(spark, sf):
    return rounded(E.average_precision(lines(spark, sf), "price", by=["split"]), 7)


@query("precision_recall_auc", "L5", f"WITH {LINES}, {curve_sql('net')} SELECT split, {PR} FROM c GROUP BY split")
def _(spark, sf):
    return rounded(E.pr_auc(lines(spark, sf), "net", by=["split"]), 7)


# predictions for windows: the deviation of the values is the probability, above 50 is malicious
PRED_SQL = META_SQL + """,
pw AS (SELECT source, window_id, round(stddev_pop(value), 7) AS prob FROM win GROUP BY ALL),
pm AS (SELECT m.*, prob, CAST(prob > 50 AS INTEGER) AS pred FROM meta m JOIN pw USING (source, window_id))"""
PER_ATTACK = """ar AS (SELECT attack, count(*) AS "count", count(*) FILTER (pred = 1) AS tp, count(*) FILTER (pred = 0) AS fn,
  count(*) FILTER (pred = 1) / count(*) AS detection_rate, avg(prob) AS mean_prob, quantile_cont(prob, 0.5) AS median_prob FROM {src} GROUP BY attack)
SELECT attack, "count", tp, fn, round(detection_rate, 6) AS detection_rate, round(mean_prob, 5) AS mean_prob, round(median_prob, 5) AS median_prob,
  row_number() OVER (ORDER BY detection_rate DESC, attack) AS place FROM ar"""


def aligned(spark, sf):
    pos = positioned(spark, sf)
    sizes = materialise(win.source_sizes(pos, SPEC))
    pred = win.integrate(G.window_stats(pos, SPEC, ["value"], ("std",)), sizes, SPEC).select(
        "global_window_id", F.round("value_std", 7).alias("prob"))
    pred = pred.withColumn("pred", (F.col("prob") > 50).cast("int"))
    return T.with_attacks(T.align(pred, win.integrate(win.window_meta(pos, SPEC), sizes, SPEC)))


@query("attack_recall", "L6", f"""WITH {PRED_SQL}, ax AS (SELECT a.label AS attack, pred, prob FROM pm JOIN attacks a USING (source, window_id)),
{PER_ATTACK.format(src='ax')}""")
def _(spark, sf):
    r = T.attack_recall(aligned(spark, sf))
    return rounded(r.withColumns({"mean_prob": F.round("mean_prob", 5), "median_prob": F.round("median_prob", 5)}))


@query("attack_recall_pure", "L7", f"""WITH {PRED_SQL}, one AS (SELECT source, window_id FROM attacks GROUP BY ALL HAVING count(*) = 1),
ax AS (SELECT a.label AS attack, pred, prob FROM pm JOIN attacks a USING (source, window_id) JOIN one USING (source, window_id)),
{PER_ATTACK.format(src='ax')}""")
def _(spark, sf):
    r = T.attack_recall(aligned(spark, sf), pure=True)
    return rounded(r.withColumns({"mean_prob": F.round("mean_prob", 5), "median_prob": F.round("median_prob", 5)}))


@query("attack_set_stats", "L8", f"""WITH {META_SQL}, z AS (SELECT m.source, m.window_id, count(a.label) AS k FROM meta m LEFT JOIN attacks a USING (source, window_id) GROUP BY ALL)
SELECT 'benign_windows' AS statistic, count(*) AS n FROM z WHERE k = 0 UNION ALL SELECT 'malicious_windows', count(*) FROM z WHERE k > 0
UNION ALL SELECT 'mixed_windows', count(*) FROM z WHERE k > 1 UNION ALL SELECT 'attack_set_size_' || k, count(*) FROM z WHERE k > 0 GROUP BY k""")
def _(spark, sf):
    return T.attack_set_stats(T.with_attacks(with_meta(spark, sf)[0]))


@query("attacks_of_window", "L9", f"""WITH {META_SQL}
SELECT source, window_id, string_agg(label, ',' ORDER BY label) AS attacks FROM attacks GROUP BY ALL""")
def _(spark, sf):
    m = T.with_attacks(with_meta(spark, sf)[0]).where(F.size("attacks") > 0)
    return m.select(*KEY, F.array_join("attacks", ",").alias("attacks"))


@query("benign_accuracy", "L10", f"""WITH {PRED_SQL} SELECT count(*) AS "count", count(*) FILTER (pred = 0) AS correct,
count(*) FILTER (pred = 1) AS incorrect, round(count(*) FILTER (pred = 0) / count(*), 6) AS accuracy FROM pm WHERE is_malicious = 0""")
def _(spark, sf):
    return rounded(T.benign_accuracy(aligned(spark, sf)))


@query("aligned_predictions", "L11", f"""WITH {PRED_SQL} SELECT gid AS global_window_id, source, is_malicious, pred FROM pm""")
def _(spark, sf):
    return aligned(spark, sf).select("global_window_id", "source", "is_malicious", "pred")


@query("score_histogram", "L12", f"""WITH {LINES}, z AS (SELECT split, label, price / 50000 AS s FROM ls),
c AS (SELECT split, label, least(CAST(floor((s - 0.0) * 45 / 2.0) AS BIGINT), 44) AS bin, count(*) AS n FROM z WHERE s BETWEEN 0 AND 2 GROUP BY ALL),
g AS (SELECT split, label, bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT split, label FROM ls)
  CROSS JOIN (SELECT unnest(generate_series(CAST(0 AS BIGINT), 44)) AS bin) LEFT JOIN c USING (split, label, bin))
SELECT split, label, bin, n, round(bin * (2.0 / 45), 6) AS "left", round((bin + 1) * (2.0 / 45), 6) AS "right",
  round(n / (sum(n) OVER (PARTITION BY split, label) * (2.0 / 45)), 6) AS density FROM g""")
def _(spark, sf):
    return rounded(E.score_histogram(lines(spark, sf).withColumn("s", F.col("price") / 50000), "s", ["split", "label"]))


@query("score_density", "L13", f"""WITH {LINES}, z AS (SELECT split, label, round(tax * 20, 6) AS s, count(*) AS n FROM ls GROUP BY ALL),
f AS (SELECT split, label, count(*) AS n_all, stddev_samp(round(tax * 20, 6)) * pow(count(*), -0.2) AS bw FROM ls GROUP BY ALL),
g AS (SELECT i, i * (2.0 / 399) AS x FROM (SELECT unnest(range(400)) AS i))
SELECT split, label, round(x, 6) AS x, round(sum(n * exp(-0.5 * pow((x - s) / bw, 2))) / (max(bw) * max(n_all) * sqrt(2 * pi())), 6) AS density
FROM z JOIN f USING (split, label), g GROUP BY split, label, x""")
def _(spark, sf):
    return rounded(E.score_kde(lines(spark, sf).withColumn("s", F.round(F.col("tax") * 20, 6)), "s", ["split", "label"]))


@query("score_ecdf", "L14", f"""WITH {LINES}, c AS (SELECT split, net, cume_dist() OVER (PARTITION BY split ORDER BY net) AS cdf FROM (SELECT split, round(net, 6) AS net FROM ls))
SELECT DISTINCT split, net, round(cdf, 7) AS cdf FROM c""")
def _(spark, sf):
    return rounded(E.ecdf(lines(spark, sf).withColumn("net", F.round("net", 6)), "net", ["split"]), 7)


@query("branch_metrics", "L15", f"""WITH {LINES.replace('ls AS', 'ls0 AS')},
ls AS (UNPIVOT (SELECT split, label, price, tax FROM ls0) ON price, tax INTO NAME branch VALUE s),
rng AS (SELECT branch, min(s) AS lo, max(s) AS hi FROM ls WHERE split = 'val' GROUP BY branch),
grid AS (SELECT branch, i, CASE WHEN i = 999 THEN hi ELSE i * ((hi - lo) / 999) + lo END AS t FROM rng, (SELECT unnest(range(1000)) AS i)),
vs AS (SELECT * FROM ls WHERE split = 'val'), {best_sql('grid', 'vs', 'branch', 's')},
cm AS (SELECT l.branch, max(t) AS t, count(*) FILTER (s > t AND label = 1) AS tp, count(*) FILTER (s > t AND label = 0) AS fp,
  count(*) FILTER (s <= t AND label = 1) AS fn FROM ls l JOIN best b ON l.branch = b.branch WHERE l.split = 'test' GROUP BY l.branch),
cv AS (SELECT branch, s, count(*) AS n, sum(label) AS pos FROM ls WHERE split = 'test' GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS hit, sum(pos) OVER (PARTITION BY branch) AS p, sum(n) OVER (PARTITION BY branch) AS a,
  sum(n) OVER (PARTITION BY branch ORDER BY s) AS below FROM cv WINDOW w AS (PARTITION BY branch ORDER BY s DESC)),
rk AS (SELECT branch, {AUC}, {AP.replace('average_precision', 'auc_pr')} FROM c GROUP BY branch)
SELECT branch, round(t, 5) AS threshold, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, auc_roc, auc_pr FROM cm JOIN rk USING (branch)""")
def _(spark, sf):
    d = lines(spark, sf)
    b = E.branch_metrics(d.where("split = 'val'"), d.where("split = 'test'"), ["price", "tax"])
    return b.select("branch", F.round("threshold", 5).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")],
                    F.round("auc_roc", 7).alias("auc_roc"), F.round("auc_pr", 7).alias("auc_pr"))


@query("evaluation", "L2 L3 L4", f"""WITH {LINES.replace('AS ls0', '')}, t AS (SELECT * FROM ls WHERE split = 'test'),
k AS (SELECT count(*) FILTER (price > 60000 AND label = 1) AS tp, count(*) FILTER (price > 60000) AS hit, count(*) FILTER (label = 1) AS actual FROM t),
{curve_sql('price')}, r AS (SELECT split, {AUC}, {AP.replace('average_precision', 'auc_pr')} FROM c GROUP BY split)
SELECT CAST(60000 AS DOUBLE) AS threshold, round(2 * tp / (hit + actual), 6) AS f1, round(tp / hit, 6) AS precision, round(tp / actual, 6) AS recall,
  auc_roc, auc_pr FROM k, r WHERE split = 'test'""")
def _(spark, sf):
    e = E.evaluate(lines(spark, sf).where("split = 'test'"), "price", 60000.0)
    return e.select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")],
                    *[F.round(c, 7).alias(c) for c in ("auc_roc", "auc_pr")])


@query("score_table", "L16", f"""WITH {LINES} SELECT split, CASE WHEN label = 1 THEN 'anomalous' ELSE 'normal' END AS "group", label, price, tax FROM ls""")
def _(spark, sf):
    return J.score_table(lines(spark, sf), ["price", "tax"])


@query("class_report", "L17", f"""WITH {LINES}, p AS (SELECT l_returnflag AS y, CASE WHEN price > 70000 THEN 'A' WHEN price > 30000 THEN 'N' ELSE 'R' END AS z FROM ls),
c AS (SELECT DISTINCT y AS class FROM p)
SELECT class, round(count(*) FILTER (y = class AND z = class) / count(*) FILTER (z = class), 6) AS precision,
  round(count(*) FILTER (y = class AND z = class) / count(*) FILTER (y = class), 6) AS recall,
  round(2 * count(*) FILTER (y = class AND z = class) / (count(*) FILTER (z = class) + count(*) FILTER (y = class)), 6) AS f1,
  count(*) FILTER (y = class) AS support FROM p, c GROUP BY class""")
def _(spark, sf):
    p = lines(spark, sf).withColumn("z", F.when(F.col("price") > 70000, "A").when(F.col("price") > 30000, "N").otherwise("R"))
    return rounded(E.class_report(p, "z", "l_returnflag"))


@query("confusion_from_rates", "L18", f"""WITH {CM_SQL} SELECT split, tn, fp, fn, tp FROM cm""")
def _(spark, sf):
    d = judged(spark, sf)
    rates = E.prf(d, by=["split"]).join(d.groupBy("split").agg(
        F.count_if(F.col("label") == 1).alias("total_positive"), F.count_if(F.col("label") == 0).alias("total_negative")), "split")
    return E.confusion_from_pr(rates).select("split", "tn", "fp", "fn", "tp")


@query("score_by_class", "L19", f"""WITH {LINES} SELECT label, round(avg(price), 5) AS mean_score, count(*) AS n FROM ls GROUP BY label""")
def _(spark, sf):
    return rounded(J.score_by_class(lines(spark, sf), "price"), 5)


# ---- importances -------------------------------------------------------------------------------------------------

# importance of a customer: the share of all order value; a table with skew, derived from orders
IMP_SQL = """imp AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS feature, CAST(o_custkey AS INTEGER) AS ordinal,
  round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 12) AS importance FROM orders GROUP BY o_custkey),
tab AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
  sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative FROM imp)"""


def importances(spark, sf):
    o = table(spark, sf, "orders")
    total = o.agg(F.sum("o_totalprice").alias("t")).first()["t"]
    return o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).select(
        F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("feature"),
        F.col("o_custkey").cast("int").alias("ordinal"), F.round(F.col("s") / total, 12).alias("importance"))


@query("forest_importance_flows", "M1 E8")
def _(spark, sf):
    return models.rf_importance(line_rows(spark, sf), LINE_COLS, key="key", sample=20000, trees=20, depth=6)


@query("forest_importance_windows", "M2")
def _(spark, sf):
    return models.rf_importance(stat_rows(spark, sf), STAT_COLS, trees=20, depth=5)


@query("importance_table", "M3", f"""WITH {IMP_SQL} SELECT feature, ordinal, round(importance, 12) AS importance, rank, round(cumulative, 12) AS cumulative FROM tab""")
def _(spark, sf):
    return rounded(M.importance_table(importances(spark, sf)), 12)


@query("importance_cutoffs", "M4", f"""WITH {IMP_SQL}, t AS (SELECT unnest([0.5, 0.8, 0.9, 0.95, 0.99]) AS x)
SELECT CAST(x AS DOUBLE) AS threshold, min(rank) FILTER (cumulative >= x) AS features,
  round(min(rank) FILTER (cumulative >= x) * 100 / count(*), 6) AS pct FROM tab, t GROUP BY x""")
def _(spark, sf):
    return rounded(M.importance_cutoffs(importances(spark, sf)))


@query("features_reaching_half", "M4 C3", f"""WITH {IMP_SQL} SELECT rank, feature, round(importance, 9) AS importance FROM tab
WHERE rank <= (SELECT min(rank) FROM tab WHERE cumulative >= 0.5)""")
def _(spark, sf):
    return rounded(M.features_reaching(importances(spark, sf), 0.5), 9)


@query("low_importance", "M5", f"""WITH {IMP_SQL}, t AS (SELECT unnest([0.0001, 0.001, 0.01]) AS x)
SELECT CAST(x AS DOUBLE) AS threshold, count(*) FILTER (importance < x) AS features, round(count(*) FILTER (importance < x) * 100 / count(*), 6) AS pct,
  coalesce(list_aggregate(list_slice(list(feature ORDER BY importance DESC, feature) FILTER (importance < x), 1, 5), 'string_agg', ','), '') AS first FROM imp, t GROUP BY x""")
def _(spark, sf):
    low = M.low_importance(importances(spark, sf))
    return rounded(low.withColumn("first", F.array_join("first", ",")))


@query("importance_stats", "M6", f"""WITH {IMP_SQL} SELECT count(*) AS features, round(avg(importance), 9) AS mean, round(quantile_cont(importance, 0.5), 9) AS median,
round(stddev_samp(importance), 9) AS std, round(max(importance), 9) AS max, round(min(importance), 9) AS min,
round(quantile_cont(importance, 0.7), 9) AS q70, round(quantile_cont(importance, 0.9), 9) AS q90 FROM imp""")
def _(spark, sf):
    return rounded(M.importance_stats(importances(spark, sf)), 9)


@query("importance_histogram", "M6 F5", f"""WITH {IMP_SQL}, r AS (SELECT min(importance) AS lo, max(importance) AS hi, quantile_cont(importance, 0.7) AS a, quantile_cont(importance, 0.9) AS b FROM imp),
c AS (SELECT least(CAST(floor((importance - lo) * 50 / (hi - lo)) AS BIGINT), 49) AS bin, count(*) AS n FROM imp, r GROUP BY ALL)
SELECT g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(lo + g.bin * ((hi - lo) / 50), 9) AS "left", round(lo + (g.bin + 1) * ((hi - lo) / 50), 9) AS "right",
  CASE WHEN lo + g.bin * ((hi - lo) / 50) > b THEN 'top' WHEN lo + g.bin * ((hi - lo) / 50) > a THEN 'high' ELSE 'base' END AS level
FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 49)) AS bin) g LEFT JOIN c USING (bin), r""")
def _(spark, sf):
    return rounded(M.importance_histogram(importances(spark, sf)), 9)


@query("top_features", "M7", f"""WITH {IMP_SQL} SELECT ordinal, feature, round(importance, 9) AS importance FROM tab WHERE rank <= 25""")
def _(spark, sf):
    return rounded(M.select_top_k(importances(spark, sf), 25), 9)


@query("features_above_median", "M8", f"""WITH {IMP_SQL} SELECT feature, ordinal, round(importance, 9) AS importance FROM imp
WHERE importance >= (SELECT quantile_cont(importance, 0.5) FROM imp)""")
def _(spark, sf):
    return rounded(M.select_median(importances(spark, sf)), 9)


@query("decoded_flat_importance", "M9", f"""WITH {IMP_SQL}, f AS (SELECT ordinal AS idx, importance FROM imp)
SELECT CAST(row_number() OVER (ORDER BY importance DESC, idx DESC) AS INTEGER) AS rank, idx, CAST(idx // 38 AS INTEGER) AS time_step,
  CAST(idx % 38 AS INTEGER) AS feature_idx, round(importance, 9) AS importance FROM f ORDER BY importance DESC, idx DESC LIMIT 10""")
def _(spark, sf):
    return rounded(M.decode_flat(importances(spark, sf).withColumnRenamed("ordinal", "idx"), 38), 9)
