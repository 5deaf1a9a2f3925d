"""Queries over positions, windows and window metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpane.operators import windows as win
from workload.inputs import (FEATURES, FLOWS_SQL, META_SQL, SPEC, WIN_SQL, flows, labelled_windows, meta_frame,
                             positioned, query, table)

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def daily(spark, pos, spec):
    w = win.window_labels(pos, spec)
    return w.groupBy("source").agg(
        F.count_if(F.col("is_malicious") == 0).alias("normal_windows"),
        F.count_if(F.col("is_malicious") == 1).alias("abnormal_windows"))


@query("daily_window_labels", "A4 D1 D2 D4", f"""WITH {META_SQL}
SELECT source, count(*) FILTER (is_malicious = 0) AS normal_windows,
       count(*) FILTER (is_malicious = 1) AS abnormal_windows FROM meta GROUP BY source""")
def _(spark, sf):
    return daily(spark, positioned(spark, sf), SPEC)


@query("flow_positions", "D1", f"""WITH {FLOWS_SQL} SELECT source, event_id, pos, n_rows FROM placed""")
def _(spark, sf):
    return positioned(spark, sf).select("source", "event_id", "pos", "n_rows")


@query("flow_positions_long_source", "D1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pos, n_rows FROM (
SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) - 1 AS pos,
  count(*) OVER (PARTITION BY l_linestatus) AS n_rows FROM lineitem)""")
def _(spark, sf):
    from flowpane.operators.ordered import with_position
    return with_position(
        table(spark, sf, "lineitem"), ["l_linestatus"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos", "n_rows")


@query("sliding_windows", "D2", f"""WITH {WIN_SQL}
SELECT source, window_id, woff AS "offset", event_id, value FROM win""")
def _(spark, sf):
    return win.sliding_windows(positioned(spark, sf), SPEC).select("source", "window_id", "offset", "event_id", "value")


@query("window_meta", "D3 D4 D5 D6 D7", f"""WITH {META_SQL},
amap AS (SELECT source, window_id, string_agg(label || '=' || cnt, ',' ORDER BY label) AS attack_types
         FROM attacks GROUP BY ALL),
labs AS (SELECT source, window_id, string_agg(label, ',' ORDER BY woff) AS original_labels FROM win GROUP BY ALL)
SELECT source, window_id, start_idx, end_idx, strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
       strftime(end_time, '%Y-%m-%d %H:%M:%S.%f') AS end_time, is_malicious, n_malicious,
       coalesce(attack_types, '') AS attack_types, primary_attack, original_labels
FROM meta LEFT JOIN amap USING (source, window_id) LEFT JOIN labs USING (source, window_id)""")
def _(spark, sf):
    m = win.window_meta(positioned(spark, sf), SPEC, original_labels=True)
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("attack_types")), lambda k: F.concat(
        k, F.lit("="), F.element_at("attack_types", k).cast("string"))), ",")
    return m.select("source", "window_id", "start_idx", "end_idx", F.date_format("start_time", STAMP).alias("start_time"),
                    F.date_format("end_time", STAMP).alias("end_time"), "is_malicious", "n_malicious",
                    shown.alias("attack_types"), "primary_attack",
                    F.array_join("original_labels", ",").alias("original_labels"))


@query("window_label_ratio", "D4", f"""WITH {META_SQL}
SELECT source, window_id, n_malicious, round(n_malicious / 100.0, 6) AS malicious_ratio,
       CAST(n_malicious / 100.0 > 0.01 AS INTEGER) AS is_malicious FROM meta""")
def _(spark, sf):
    return win.window_labels(positioned(spark, sf), SPEC, 0.01).select(
        "source", "window_id", "n_malicious", F.round("malicious_ratio", 6).alias("malicious_ratio"), "is_malicious")


@query("integrated_windows", "D8", f"""WITH {META_SQL}
SELECT source, window_id, gid AS global_window_id, is_malicious FROM meta""")
def _(spark, sf):
    return labelled_windows(spark, sf).select("source", "window_id", "global_window_id", "is_malicious")


@query("integrated_windows_declared_order", "D8", f"""WITH {META_SQL}
SELECT source, window_id, row_number() OVER (ORDER BY source DESC, window_id) - 1 AS global_window_id FROM meta""")
def _(spark, sf):
    p = positioned(spark, sf)
    names = sorted((r[0] for r in p.select("source").distinct().collect()), reverse=True)
    sizes = win.source_sizes(p, SPEC, names)
    return win.integrate(win.window_labels(p, SPEC), sizes, SPEC).select("source", "window_id", "global_window_id")


@query("source_index", "D9", f"""WITH {META_SQL}
SELECT source, min(gid) AS "start", max(gid) + 1 AS "end" FROM meta GROUP BY source""")
def _(spark, sf):
    return win.source_index(labelled_windows(spark, sf))


@query("flattened_windows", "D10", f"""WITH {WIN_SQL}
SELECT label, count(*) AS flow_rows, count(DISTINCT value) AS distinct_values FROM win GROUP BY label""")
def _(spark, sf):
    flat = win.flatten_windows(win.sliding_windows(positioned(spark, sf), SPEC), ["value"])
    return flat.groupBy("label").agg(F.count(F.lit(1)).alias("flow_rows"),
                                     F.countDistinct("value").alias("distinct_values"))


@query("window_checks", "D11", f"""WITH {META_SQL}, per AS (SELECT source, window_id, count(*) AS n FROM win GROUP BY ALL)
SELECT (SELECT count(*) FROM per) AS windows, (SELECT count(*) FROM meta) AS meta_windows,
       CAST((SELECT sum(n) FROM per) AS BIGINT) AS rows, (SELECT count(*) FROM per WHERE n <> 100) AS wrong_length,
       CAST(0 AS BIGINT) AS unmatched, CAST(2 AS BIGINT) AS features""")
def _(spark, sf):
    p = positioned(spark, sf)
    return win.verify_windows(win.sliding_windows(p, SPEC), win.window_labels(p, SPEC), SPEC, FEATURES)
