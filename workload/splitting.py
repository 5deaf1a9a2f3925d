"""Queries over splits, samples and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.operators import profile as P
from flowpane.operators import sampling as S
from flowpane.operators import splits as X
from flowpane.operators import windows as win
from flowpane.session import materialise
from workload.inputs import (FEATURES, FLOWS_SQL, META_SQL, SPEC, SPLIT_SQL, WIN_SQL, flows, positioned, query, table)


def rounded(df, digits=6):
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_meta(spark, sf):
    pos = positioned(spark, sf)
    sizes = materialise(win.source_sizes(pos, SPEC))
    return win.integrate(win.window_meta(pos, SPEC), sizes, SPEC).withColumn(
        "malicious_ratio", F.col("n_malicious") / SPEC.size), X.total_windows(sizes)


def with_labels(spark, sf):
    pos = positioned(spark, sf)
    sizes = materialise(win.source_sizes(pos, SPEC))
    return win.integrate(win.window_labels(pos, SPEC), sizes, SPEC), X.total_windows(sizes)


@query("chronological_split", "E1", f"""WITH {SPLIT_SQL} SELECT source, window_id, gid AS global_window_id, split FROM split""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return X.split_chrono(m, n).select("source", "window_id", "global_window_id", "split")


@query("normal_only_training_split", "E2", f"""WITH {SPLIT_SQL}
SELECT split, count(*) AS windows, CAST(sum(is_malicious) AS BIGINT) AS malicious FROM split
WHERE split <> 'train' OR is_malicious = 0 GROUP BY split""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return X.split_unsupervised(m, n).groupBy("split").agg(F.count(F.lit(1)).alias("windows"),
                                                           F.sum("is_malicious").alias("malicious"))


INFO_SQL = """info AS (SELECT count(*) FILTER (split = 'train') AS train_before_filter,
  count(*) FILTER (split = 'train' AND is_malicious = 1) AS train_removed,
  count(*) FILTER (split = 'train' AND is_malicious = 0) AS train_normal,
  count(*) FILTER (split = 'val') AS val_total, count(*) FILTER (split = 'val' AND is_malicious = 0) AS val_normal,
  count(*) FILTER (split = 'val' AND is_malicious = 1) AS val_anomalous,
  count(*) FILTER (split = 'test') AS test_total, count(*) FILTER (split = 'test' AND is_malicious = 0) AS test_normal,
  count(*) FILTER (split = 'test' AND is_malicious = 1) AS test_anomalous FROM split)"""


@query("split_info", "E2", f"""WITH {SPLIT_SQL}, {INFO_SQL} SELECT * FROM info""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return X.split_info(X.split_chrono(m, n))


@query("split_assessment", "E6", f"""WITH {SPLIT_SQL}, {INFO_SQL} SELECT train_normal, CASE WHEN train_normal > 10000
THEN 'sufficient' WHEN train_normal > 3000 THEN 'adequate' ELSE 'insufficient' END AS verdict FROM info""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return X.split_assess(X.split_info(X.split_chrono(m, n)))


TRAIN_DAYS = [f"2024-01-{d:02d}" for d in range(1, 11)]
VAL_DAYS = [f"2024-01-{d:02d}" for d in range(11, 16)]
TEST_DAYS = [f"2024-01-{d:02d}" for d in range(13, 32)]
quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
BY_SOURCE_SQL = META_SQL + f""", bysource AS (
SELECT meta.*, CASE WHEN source IN ({quoted(TRAIN_DAYS)}) AND is_malicious = 0 THEN 'train'
  WHEN source IN ({quoted(VAL_DAYS)}) AND is_malicious = 0 THEN 'val'
  WHEN source IN ({quoted(TEST_DAYS)}) AND (source NOT IN ({quoted(VAL_DAYS)}) OR is_malicious = 1) THEN 'test' END AS split
  FROM meta)"""


@query("split_by_source", "E3", f"""WITH {BY_SOURCE_SQL} SELECT source, window_id, split FROM bysource""")
def _(spark, sf):
    m, _n = with_labels(spark, sf)
    return X.split_by_source(m, TRAIN_DAYS, VAL_DAYS, TEST_DAYS, keep_rest=True).select("source", "window_id", "split")


@query("split_purity", "E4", f"""WITH {BY_SOURCE_SQL}
SELECT split, count(*) AS windows, round(avg(is_malicious) * 100, 6) AS anomaly_rate FROM bysource GROUP BY split""")
def _(spark, sf):
    m, _n = with_labels(spark, sf)
    return rounded(X.split_purity(X.split_by_source(m, TRAIN_DAYS, VAL_DAYS, TEST_DAYS, keep_rest=True)))


BALANCED_SQL = META_SQL + """,
per AS (SELECT source, count(*) AS n, sum(is_malicious) AS m, max(gid) AS last FROM meta GROUP BY source),
bounds AS (SELECT row_number() OVER (ORDER BY last) - 1 AS i, sum(n) OVER (ORDER BY last) AS b,
  sum(m) OVER (ORDER BY last) AS c, count(*) OVER () AS sources, sum(n) OVER () AS total, sum(m) OVER () AS bad FROM per),
pairs AS (SELECT x.i, y.i AS j, x.b AS train_end, y.b AS val_end, CAST(x.c AS DOUBLE) / x.b AS tr,
  CAST(y.c - x.c AS DOUBLE) / (y.b - x.b) AS va, CAST(x.bad - y.c AS DOUBLE) / (x.total - y.b) AS te
  FROM bounds x JOIN bounds y ON y.i > x.i WHERE x.i BETWEEN 1 AND x.sources - 2 AND y.b < x.total * 0.9),
best AS (SELECT * FROM pairs ORDER BY abs(tr - {t}) + 2 * abs(va - {t}) + abs(te - {t}), i, j LIMIT 1)"""


@query("balanced_split_points", "E5", f"""WITH {BALANCED_SQL.format(t=0.25)}
SELECT CAST(train_end AS BIGINT) AS train_end, CAST(val_end AS BIGINT) AS val_end, round(va, 6) AS val_ratio,
       abs(va - 0.25) <= 0.03 AS in_tolerance, false AS fallback FROM best""")
def _(spark, sf):
    m, _n = with_labels(spark, sf)
    return rounded(X.balanced_points(m))


@query("balanced_split", "E5", f"""WITH {BALANCED_SQL.format(t=0.5)},
s AS (SELECT CASE WHEN gid < train_end THEN 'train' WHEN gid < val_end THEN 'val' ELSE 'test' END AS split FROM meta, best)
SELECT split, count(*) AS windows FROM s GROUP BY split""")
def _(spark, sf):
    m, _n = with_labels(spark, sf)
    return X.split_balanced(m, X.balanced_points(m, 0.5)).groupBy("split").agg(F.count(F.lit(1)).alias("windows"))


@query("attack_by_split", "E7", f"""WITH {SPLIT_SQL}, t AS (
SELECT CASE WHEN is_malicious = 1 THEN primary_attack ELSE 'Benign' END AS attack, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM split GROUP BY ALL)
SELECT *, train + val + test AS total, round(train * 100 / (train + val + test), 6) AS train_pct,
  round(test * 100 / (train + val + test), 6) AS test_pct FROM t""")
def _(spark, sf):
    m, n = with_meta(spark, sf)
    return rounded(X.attack_by_split(X.split_chrono(m, n)))


HASH_SQL = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


@query("stratified_sample", "E8", f"""WITH {FLOWS_SQL},
c AS (SELECT event_id, CAST(label <> 'Benign' AS INTEGER) AS y, {HASH_SQL.format(k='event_id', seed=7)} AS h FROM flows),
q AS (SELECT CAST(floor(2000 * (CAST(sum(y) AS DOUBLE) / count(*))) AS BIGINT) AS a FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, event_id) AS rn FROM c)
SELECT event_id, y FROM r, q WHERE rn <= CASE WHEN y = 1 THEN a ELSE 2000 - a END""")
def _(spark, sf):
    f = flows(spark, sf).select("event_id", L.is_malicious(F.col("label")).alias("y"))
    return S.stratified_sample(f, "y", "event_id", 2000, 7)


@query("sampled_windows", "E9", f"""WITH {META_SQL},
r AS (SELECT source, window_id, row_number() OVER (ORDER BY {HASH_SQL.format(k='gid', seed=3)}, gid) AS rn FROM meta)
SELECT source, window_id FROM r WHERE rn <= (SELECT floor(count(*) * 0.3) FROM meta)""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return S.sample_windows(m, n, 0.3, 3).select("source", "window_id")


# ---- profiles ----------------------------------------------------------------------------------------------------

@query("label_distribution", "F1", f"""WITH {FLOWS_SQL}
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM flows GROUP BY label""")
def _(spark, sf):
    return rounded(P.label_distribution(flows(spark, sf)))


FLOW_DIST = """fd AS (SELECT split, w.label, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY split), 6) AS pct
FROM split JOIN win w USING (source, window_id) GROUP BY split, w.label)"""
WIN_DIST = """wd AS (SELECT split, count(*) AS windows, count(*) FILTER (is_malicious = 0) AS normal_windows,
count(*) FILTER (is_malicious = 1) AS malicious_windows,
round(count(*) FILTER (is_malicious = 1) * 100 / count(*), 6) AS malicious_pct FROM split GROUP BY split)"""


@query("flow_distribution", "F2", f"""WITH {SPLIT_SQL}, {FLOW_DIST} SELECT * FROM fd""")
def _(spark, sf):
    m, n = with_meta(spark, sf)
    return rounded(P.flow_distribution(X.split_chrono(m, n), SPEC.size))


@query("window_distribution", "F3", f"""WITH {SPLIT_SQL}, {WIN_DIST} SELECT * FROM wd""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return rounded(P.window_distribution(X.split_chrono(m, n)))


@query("malicious_ratio_stats", "F4", f"""WITH {SPLIT_SQL}, r AS (SELECT split, n_malicious / 100.0 AS r FROM split)
SELECT split, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(CAST(min(r) AS DOUBLE), 6) AS min,
  round(CAST(max(r) AS DOUBLE), 6) AS max, count(*) FILTER (r = 0) AS "none", count(*) FILTER (r = 1) AS "full",
  count(*) FILTER (r > 0 AND r < 1) AS mixed FROM r GROUP BY split""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return rounded(P.malicious_ratio_stats(X.split_chrono(m, n)))


@query("malicious_ratio_histogram", "F5", f"""WITH {META_SQL}, r AS (SELECT CAST(n_malicious AS DOUBLE) / 100 AS x FROM meta),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
c AS (SELECT least(CAST(floor((x - lo) * 50 / (hi - lo)) AS BIGINT), 49) AS bin, count(*) AS n FROM r, b GROUP BY ALL)
SELECT g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(lo + g.bin * ((hi - lo) / 50), 6) AS "left",
  round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS "right"
FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 49)) AS bin) g LEFT JOIN c USING (bin), b""")
def _(spark, sf):
    m, _n = with_labels(spark, sf)
    return rounded(P.histogram(m, "malicious_ratio", 50))


@query("daily_distribution", "F6", f"""WITH {META_SQL}
SELECT source, count(*) FILTER (is_malicious = 0) AS normal, count(*) FILTER (is_malicious = 1) AS abnormal,
  count(*) AS total, CAST(grouping(source) AS INTEGER) AS is_total,
  round(count(*) FILTER (is_malicious = 1) * 100 / count(*), 6) AS abnormal_pct,
  round(CASE WHEN count(*) FILTER (is_malicious = 1) > 0 THEN
    count(*) FILTER (is_malicious = 0) / count(*) FILTER (is_malicious = 1) END, 6) AS normal_per_abnormal
FROM meta GROUP BY ROLLUP (source)""")
def _(spark, sf):
    m, _n = with_labels(spark, sf)
    return rounded(P.daily_distribution(m))


@query("attack_breakdown", "F7", f"""WITH {META_SQL}
SELECT label AS attack, count(*) AS windows, CAST(sum(cnt) AS BIGINT) AS flow_rows FROM attacks GROUP BY label""")
def _(spark, sf):
    return P.attack_breakdown(with_meta(spark, sf)[0])


@query("integration_summary", "F8", f"""WITH {META_SQL}, s AS (
SELECT 'windows_by_class' AS section, CASE WHEN is_malicious = 1 THEN 'malicious' ELSE 'normal' END AS key, count(*) AS n
FROM meta GROUP BY ALL UNION ALL SELECT 'windows_by_source', source, count(*) FROM meta GROUP BY source
UNION ALL SELECT 'flows_by_label', label, count(*) FROM win GROUP BY label)
SELECT *, round(n / sum(n) OVER (PARTITION BY section), 6) AS share FROM s""")
def _(spark, sf):
    return rounded(P.integration_summary(with_meta(spark, sf)[0], SPEC.size))


EPISODE_SQL = META_SQL + """, m AS (SELECT gid, primary_attack AS attack FROM meta WHERE is_malicious = 1),
f AS (SELECT m.*, CASE WHEN p.attack = m.attack THEN 0 ELSE 1 END AS s FROM m LEFT JOIN m p ON p.gid = m.gid - 1),
isl AS (SELECT *, sum(s) OVER (ORDER BY gid) AS episode FROM f),
ep AS (SELECT CAST(episode AS BIGINT) AS episode, min(attack) AS attack, min(gid) AS first_window, max(gid) AS last_window,
  count(*) AS windows, count(*) * 100 AS duration FROM isl GROUP BY episode)"""


@query("attack_episodes", "F9", f"""WITH {EPISODE_SQL} SELECT * FROM ep""")
def _(spark, sf):
    return P.attack_episodes(with_meta(spark, sf)[0], SPEC.size)


@query("episode_stats", "F10", f"""WITH {EPISODE_SQL}
SELECT attack, count(*) AS episodes, round(avg(duration), 6) AS mean, min(duration) AS min, max(duration) AS max,
  round(stddev_pop(duration), 6) AS std, round(quantile_cont(CAST(duration AS DOUBLE), 0.5), 6) AS median FROM ep GROUP BY attack""")
def _(spark, sf):
    return rounded(P.episode_stats(materialise(P.attack_episodes(with_meta(spark, sf)[0], SPEC.size))))


@query("normalisation_check", "F11", """WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa,
avg(l_tax) AS b, stddev_pop(l_tax) AS sb FROM lineitem)
SELECT 'l_quantity' AS feature, round(a, 6) AS mean, round(sa, 6) AS std FROM s UNION ALL
SELECT 'l_tax', round(b, 6), round(sb, 6) FROM s""")
def _(spark, sf):
    return rounded(P.check_normalised(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"]))


@query("distribution_report", "F12", f"""WITH {SPLIT_SQL}, {FLOW_DIST}, {WIN_DIST}
SELECT split, 'flow' AS level, label, n, pct FROM fd UNION ALL
SELECT split, 'window', 'normal', normal_windows, round(normal_windows * 100 / windows, 6) FROM wd UNION ALL
SELECT split, 'window', 'malicious', malicious_windows, malicious_pct FROM wd""")
def _(spark, sf):
    m, n = with_meta(spark, sf)
    return rounded(P.distribution_report(X.split_chrono(m, n), SPEC.size))
