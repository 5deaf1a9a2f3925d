"""Queries that run whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpane.operators import attacks as T
from flowpane.operators import models
from flowpane.operators import window_features as G
from flowpane.operators import windows as W
from flowpane.operators.catalog import select_features
from flowpane.operators.importance import features_reaching
from flowpane.plans.clean_job import CleanSpec, clean_flows
from flowpane.plans.detection_job import detection_report, score_windows
from flowpane.plans.drift_job import feature_drift, frequency_drift
from flowpane.plans.window_job import build_window_set
from flowpane.session import materialise
from flowpane.sources.readers import read_flows
from workload.cleaning import CLEANED, SECONDS, raw_flows, scratch_path
from workload.drifting import DIST_SQL, PAIR_SQL, SPEC_SQL
from workload.inputs import EVENT_ORDER, FEATURES, SPEC, flows, query
from workload.splitting import rounded


def window_set(spark, sf):
    return build_window_set(flows(spark, sf), SPEC, EVENT_ORDER, FEATURES)


@query("detection_job", "J1 J2 J5 K2 K4 K5 L2 L3 L4")
def _(spark, sf):
    return detection_report(materialise(score_windows(window_set(spark, sf), FEATURES)))


@query("feature_drift_job", "I2 I9", f"""WITH {PAIR_SQL}, {DIST_SQL.format(by='pair, feature', src='paired')},
j AS (SELECT a.feature, a.ks AS ks_a, b.ks AS ks_b, a.ks - b.ks AS diff FROM dist a JOIN dist b USING (feature) WHERE a.pair = 'A' AND b.pair = 'B')
SELECT feature, round(ks_a, 6) AS ks_a, round(ks_b, 6) AS ks_b, round(diff, 6) + 0.0 AS diff,
  CASE WHEN ks_b > 0.1 AND diff < 0.05 THEN 'Covariate' WHEN diff > 0.1 THEN 'Anomaly' ELSE 'Mixed' END AS source FROM j""")
def _(spark, sf):
    return rounded(feature_drift(window_set(spark, sf), FEATURES)).withColumn("diff", F.col("diff") + 0.0)


@query("frequency_drift_job", "I10 I11", f"""WITH {SPEC_SQL}, {DIST_SQL.format(by='bin', src='spec')},
g AS (SELECT avg(wasserstein) AS o, avg(wasserstein) FILTER (bin < 10) AS l, avg(wasserstein) FILTER (bin >= 40) AS h FROM dist)
SELECT bin, round(ks, 6) AS ks, round(wasserstein, 5) AS wasserstein, n_a, n_b, round(o, 5) AS overall_mean, round(l, 5) AS low_mean, round(h, 5) AS high_mean
FROM dist, g""")
def _(spark, sf):
    d = frequency_drift(window_set(spark, sf), FEATURES)
    means = [f"{k}_mean" for k in ("overall", "low", "high")]
    return d.select(F.col("bin").cast("bigint").alias("bin"), F.round("ks", 6).alias("ks"), F.round("wasserstein", 5).alias("wasserstein"), "n_a", "n_b",
                    *[F.round(c, 5).alias(c) for c in means])


RAW_WINDOWS = "cleaned AS (" + CLEANED.format("ts IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL", "value", "k", "value", "k").replace(
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts", "ts") + """),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, "Flow Bytes/s", "Total Fwd Packets", label) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n_rows FROM cleaned),
win AS (SELECT *, pos - window_id * 20 AS woff FROM (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((pos - 99) / 20.0) AS BIGINT)),
  least((n_rows - 100) // 20, pos // 20))) AS window_id FROM placed WHERE n_rows >= 100)),
per AS (SELECT source, window_id, count(*) FILTER (label <> 'Benign') AS n_malicious, sum("Flow Bytes/s") AS total, min(ts) AS t0, max(ts) AS t1
  FROM win GROUP BY ALL),
gid AS (SELECT *, row_number() OVER (ORDER BY source, window_id) - 1 AS global_window_id, count(*) OVER () AS n FROM per)"""


@query("raw_folder_to_windows", "A1 A5 B1 B7 B11 B13 B17 D1 D2 D3 D4 D8 D11 E1", f"""WITH {RAW_WINDOWS}
SELECT source, window_id, global_window_id, CAST(n_malicious > 0 AS INTEGER) AS is_malicious, n_malicious, round(total, 4) AS total,
  strftime(t0, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(t1, '%Y-%m-%d %H:%M:%S') AS end_time,
  CASE WHEN global_window_id < CAST(floor(n * 0.6) AS BIGINT) THEN 'train' WHEN global_window_id < CAST(floor(n * (0.6 + 0.2)) AS BIGINT) THEN 'val'
  ELSE 'test' END AS split FROM gid""")
def _(spark, sf):
    """A folder of raw CSVs under two headers, to windows of all sources in one sequence with their split."""
    path = scratch_path(spark, "raw")
    raw = raw_flows(spark, sf)
    odd = F.xxhash64("Timestamp", "Flow Byts/s") % 2 != 0
    raw.where(~odd).write.mode("append").option("header", True).csv(path)
    other = {"Flow Byts/s": "Flow Bytes/s", "Tot Fwd Pkts": "Total Fwd Packets"}
    raw.where(odd).select("Flow ID", "Label", *[F.col(c).alias(n) for c, n in other.items()], "source", "Timestamp").write.mode("append").option(
        "header", True).csv(path)
    clean = clean_flows(read_flows(spark, path, tag=None), CleanSpec(ts_format=SECONDS, na_policy="drop"))
    features = ["Flow Bytes/s", "Total Fwd Packets"]
    windows = build_window_set(clean, SPEC, ["ts", *features, "label"], features)
    sums = W.pane_windows(windows.flows, SPEC, {"s": F.sum("Flow Bytes/s"), "t0": F.min("ts"), "t1": F.max("ts")},
                          {"total": F.sum("s"), "start_time": F.min("t0"), "end_time": F.max("t1")})
    both = windows.labels().join(sums.drop("start_idx", "end_idx"), ["source", "window_id"])
    return both.select("source", "window_id", "global_window_id", "is_malicious", "n_malicious", F.round("total", 4).alias("total"),
                       *[F.date_format(c, SECONDS).alias(c) for c in ("start_time", "end_time")], "split")


@query("selected_feature_windows", "M1 M3 M4 C3 D1 D2")
def _(spark, sf):
    """Features that together reach 0.95 of a forest's importance, in their order, and the windows cut from them alone."""
    rows = flows(spark, sf).withColumns({"square": F.col("value") * F.col("value"), "parity": F.col("event_id") % 2.0})
    candidates = [*FEATURES, "square", "parity"]
    labelled = rows.withColumn("label_code", (F.col("label") != "Benign").cast("double"))
    importance = materialise(models.rf_importance(labelled, candidates, "label_code", trees=20, depth=5))
    chosen = [r["feature"] for r in features_reaching(importance, 0.95).orderBy("rank").collect()]
    kept = [c for c in candidates if c in chosen]
    slim = select_features(rows, kept, ["source", "ts", "event_id", "label"])
    windows = build_window_set(slim, SPEC, EVENT_ORDER, kept)
    return W.sliding_windows(windows.flows, SPEC).groupBy("source", "window_id").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(",".join(kept)).alias("features"))


@query("classifier_attack_recall", "J7 L6 L9 L11")
def _(spark, sf):
    """A forest on window statistics of the training part, its predictions for all windows, and what it finds of each attack."""
    windows = window_set(spark, sf)
    meta = materialise(windows.meta())
    stats = G.window_stats(windows.flows, SPEC, FEATURES)
    columns = [f"{f}_{s}" for s in ("mean", "std", "max", "min") for f in FEATURES]
    rows = materialise(windows.integrated(stats).join(meta.select("global_window_id", F.col("is_malicious").alias("label")), "global_window_id"))
    found = models.rf_classify(rows.where("split = 'train'"), rows, columns, trees=20, depth=5)
    return T.attack_recall(T.with_attacks(T.align(found.select("global_window_id", "pred", "prob"), meta)))
