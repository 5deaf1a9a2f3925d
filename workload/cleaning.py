"""Queries over sources, sinks and cleaning. ``dirty`` rows are derived from ``events`` alike in Spark and in SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.functions import numbers as N
from flowpane.functions import vocabulary as V
from flowpane.operators import catalog as K
from flowpane.operators import clean as C
from flowpane.operators import windows as win
from flowpane.plans.clean_job import CleanSpec, clean_flows, clean_headerless
from flowpane.session import scratch_dir
from flowpane.sources import readers as R
from flowpane.sources import writers as W
from workload.inputs import FEATURES, FLOWS_SQL, META_SQL, SPEC, flows, positioned, query, table

SECONDS = "yyyy-MM-dd HH:mm:ss"

DIRTY_RULE = """
SELECT event_id, source, ts, rn,
       CASE WHEN event_id % 71 = 0 THEN 'not-a-date' ELSE {fmt} END AS ts_text,
       CASE WHEN event_id % 73 = 0 THEN 'oops' ELSE CAST({secs} AS {text}) END AS epoch_text,
       CASE WHEN user_id % 50 = 7 AND event_type IN ('error', 'purchase') THEN event_type
            WHEN event_id % 3 = 0 THEN ' BENIGN' WHEN event_id % 3 = 1 THEN 'Benign' ELSE 'Benign ' END AS label_text,
       CASE WHEN event_id % 97 = 0 THEN 'Infinity' WHEN event_id % 89 = 0 THEN 'abc' WHEN event_id % 83 = 0 THEN NULL
            ELSE CAST(value AS {text}) END AS value_text,
       CASE WHEN event_id % 61 = 0 THEN ' 12 ' ELSE {k} END AS k_text,
       CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'nan' WHEN 3 THEN 'Backdoor'
            WHEN 4 THEN ' Exploits ' WHEN 5 THEN 'Infilteration' ELSE 'Normal' END AS category,
       CAST(event_id % 2 AS INT) AS flag, event_type
FROM (SELECT e.*, {day} AS source, 0 AS rn FROM events e
      UNION ALL
      SELECT e.event_id, e.ts + INTERVAL '1' SECOND AS ts, e.user_id, e.event_type, e.value, e.props, {day} AS source,
             1 AS rn FROM events e WHERE event_id % 50 = 0) u"""

DIRTY = "dirty AS (" + DIRTY_RULE.format(
    fmt="strftime(ts, '%Y-%m-%d %H:%M:%S')", secs="CAST(floor(epoch(ts)) AS BIGINT)", text="VARCHAR",
    k="json_extract_string(props, '$.k')", day="strftime(ts, '%Y-%m-%d')") + """),
typed AS (
  SELECT event_id, source, rn, try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') AS ts,
         CASE WHEN trim(label_text) = 'BENIGN' THEN 'Benign' ELSE trim(label_text) END AS label,
         CASE WHEN isinf(v) OR isnan(v) THEN NULL ELSE v END AS value, k
  FROM (SELECT *, TRY_CAST(trim(value_text) AS DOUBLE) AS v, TRY_CAST(trim(k_text) AS DOUBLE) AS k FROM dirty))"""


def dirty(spark, sf):
    events = table(spark, sf, "events")
    return spark.sql(DIRTY_RULE.replace("FROM events e", "FROM {{events}} e").format(
        fmt=f"date_format(ts, '{SECONDS}')", secs="unix_timestamp(CAST(ts AS TIMESTAMP))", text="STRING",
        k="get_json_object(props, '$.k')", day="date_format(ts, 'yyyy-MM-dd')"), events=events)


def typed(spark, sf):
    d = dirty(spark, sf).select(
        "event_id", "source", "rn", N.parse_ts(F.col("ts_text"), SECONDS).alias("ts"),
        L.canonical_label(F.col("label_text")).alias("label"), F.col("value_text").alias("value"),
        F.col("k_text").alias("k"))
    return C.null_nonfinite(C.coerce_numeric(d, ["value", "k"]), ["value", "k"])


def scratch_path(spark, name):
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


# ---- sources and sinks -------------------------------------------------------------------------------------------

@query("headed_csv_flows", "A1 A3", f"""WITH {DIRTY}
SELECT count(*) AS flow_rows, count(TRY_CAST(trim(value_text) AS DOUBLE)) AS numbers,
       count(DISTINCT trim(label_text)) AS labels FROM dirty""")
def _(spark, sf):
    path = scratch_path(spark, "headed")
    W.write_report(dirty(spark, sf).select("event_id", F.col("label_text").alias("Label"), "value_text"), path, "csv")
    return R.read_flows(spark, path).agg(
        F.count(F.lit(1)).alias("flow_rows"), F.count(N.to_number(F.col("value_text"))).alias("numbers"),
        F.countDistinct(F.trim("Label")).alias("labels"))


@query("two_header_csv_flows", "A1 B1", f"""WITH {DIRTY}
SELECT source, event_id, trim(label_text) AS label, trim(value_text) AS value_text, trim(k_text) AS packets, CASE WHEN event_id % 2 = 1 THEN event_type END AS only_odd
FROM dirty""")
def _(spark, sf):
    # one folder, two kinds of file: other names, other order, another column
    path = scratch_path(spark, "headers")
    d = dirty(spark, sf)
    even = d.where("event_id % 2 = 0").select("event_id", F.col("label_text").alias("Label"), F.col("k_text").alias("Tot Fwd Pkts"), "value_text", "source")
    odd = d.where("event_id % 2 = 1").select("source", F.col("k_text").alias("Total Fwd Packets"), F.col("event_type").alias("only odd"),
                                             F.col("label_text").alias(" Label"), "value_text", "event_id")
    for part in (even, odd):
        part.write.mode("append").option("header", True).csv(path)
    df = C.harmonise_columns(R.read_flows(spark, path, tag=None))
    return df.select("source", F.col("event_id").cast("bigint").alias("event_id"), F.trim("Label").alias("label"), F.trim("value_text").alias("value_text"),
                     F.trim("Total Fwd Packets").alias("packets"), F.col("only odd").alias("only_odd"))


@query("headerless_csv_flows", "A2 B4 B8 B20", f"""WITH {DIRTY},
raw AS (SELECT CAST(TRY_CAST(epoch_text AS DOUBLE) AS BIGINT) AS s, event_type,
  TRY_CAST(trim(value_text) AS DOUBLE) AS v,
  CASE WHEN flag = 0 OR coalesce(trim(category), '') IN ('', 'nan', 'None', 'Normal') THEN 'Benign'
       WHEN trim(category) = 'Backdoor' THEN 'Backdoors' ELSE trim(category) END AS label, event_id FROM dirty),
once AS (SELECT *, row_number() OVER (PARTITION BY event_type, coalesce(CASE WHEN isinf(v) THEN 0 ELSE v END, 0), event_id
  ORDER BY s, label) AS pick FROM raw WHERE s IS NOT NULL),
codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS proto FROM (SELECT DISTINCT event_type FROM raw))
SELECT label, count(*) AS flow_rows, CAST(sum(proto) AS DOUBLE) AS proto_sum,
       round(sum(CASE WHEN isinf(v) THEN 0 ELSE coalesce(v, 0) END), 2) AS dur_sum
FROM once JOIN codes USING (event_type) WHERE pick = 1 GROUP BY label""")
def _(spark, sf):
    values = {"proto": F.col("event_type"), "state": F.lit("CON"), "service": F.lit("-"),
              "dur": F.col("value_text"), "Stime": F.col("epoch_text"), "Ltime": F.col("epoch_text"),
              "sbytes": F.col("event_id").cast("string"), "attack_cat": F.col("category"),
              "label": F.col("flag").cast("string"), "ct_ftp_cmd": F.lit(" ")}
    path = scratch_path(spark, "headerless")
    rows = dirty(spark, sf).select(*[values.get(c, F.lit("0")).alias(c) for c in V.HEADERLESS_COLUMNS])
    # a file is a source, and copies are found within their source
    rows.repartition("sbytes").write.option("header", False).csv(path)
    df = clean_headerless(R.read_flows(spark, path, R.headerless_schema()))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("flow_rows"), F.sum("proto").alias("proto_sum"),
                                   F.round(F.sum("dur"), 2).alias("dur_sum"))


@query("report_json_round_trip", "A3", f"""WITH {FLOWS_SQL} SELECT label, count(*) AS n FROM flows GROUP BY label""")
def _(spark, sf):
    path = scratch_path(spark, "report")
    W.write_report(flows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")), path, "json")
    return spark.read.schema("label string, n bigint").json(path)


@query("clean_parquet_by_source", "A4", f"""WITH {FLOWS_SQL}
SELECT source, event_id, label, value FROM flows""")
def _(spark, sf):
    path = scratch_path(spark, "clean")
    W.write_clean(flows(spark, sf), path)
    return R.read_clean(spark, path).select("source", "event_id", "label", "value")


@query("union_of_sources", "A5", """
SELECT 'first' AS source, event_id, value, CAST(NULL AS BIGINT) AS user_id FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 'second', event_id, value, user_id FROM events WHERE event_id % 2 = 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return R.union_sources({"first": e.where("event_id % 2 = 0").select("event_id", "value"),
                            "second": e.where("event_id % 2 = 1").select("event_id", "value", "user_id")})


@query("class_extracts", "A6", f"""WITH {FLOWS_SQL}
SELECT 'malicious' AS extract, event_id, label, value FROM flows WHERE label <> 'Benign'
UNION ALL SELECT 'benign', event_id, label, value FROM flows WHERE label = 'Benign'
UNION ALL SELECT 'all', event_id, label, value FROM flows""")
def _(spark, sf):
    path = scratch_path(spark, "classes")
    W.write_by_class(flows(spark, sf), path)
    every = spark.read.parquet(path)
    extracts = {"malicious": every.where("is_malicious = 1"), "benign": every.where("is_malicious = 0"), "all": every}
    return R.union_sources({k: d.select("event_id", "label", "value") for k, d in extracts.items()}, "extract")


@query("window_set_round_trip", "A7", f"""WITH {META_SQL}
SELECT m.source, count(DISTINCT m.window_id) AS windows, count(*) AS rows, round(sum(w.value), 2) AS value_sum,
       count(DISTINCT CASE WHEN m.is_malicious = 1 THEN m.window_id END) AS malicious
FROM meta m JOIN win w USING (source, window_id) GROUP BY m.source""")
def _(spark, sf):
    pos = positioned(spark, sf)
    path = scratch_path(spark, "windows")
    long = win.sliding_windows(pos, SPEC)
    W.write_windows(long, win.window_labels(pos, SPEC), K.feature_catalog(pos.select(*FEATURES)), path)
    rows = R.read_clean(spark, f"{path}/windows").groupBy("source").agg(
        F.countDistinct("window_id").alias("windows"), F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("value"), 2).alias("value_sum"))
    bad = spark.read.parquet(f"{path}/window_meta").groupBy("source").agg(F.sum("is_malicious").alias("malicious"))
    return rows.join(bad, "source")


@query("feature_list", "A8", """
SELECT line, feature FROM (SELECT row_number() OVER (ORDER BY event_type) - 1 AS line, event_type AS feature
FROM (SELECT DISTINCT event_type FROM events))""")
def _(spark, sf):
    path = scratch_path(spark, "features")
    names = table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").coalesce(1)
    names.select(F.concat(F.lit("  "), "event_type")).write.text(path)
    return R.read_feature_list(spark, path)


# ---- projections, filters, cleaning ------------------------------------------------------------------------------

@query("harmonised_columns", "B1", """
SELECT event_id, user_id AS "Destination Port", value AS "Total Fwd Packets", event_type AS "other" FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    odd = F.col("event_id") % 2 == 1
    raw = e.select("event_id", F.when(odd, F.col("user_id")).alias("Dst Port"),
                   F.when(~odd, F.col("user_id")).alias("Destination Port"), F.col("value").alias("Tot Fwd Pkts"),
                   F.col("event_type").alias("other"))
    return C.harmonise_columns(raw)


@query("dropped_columns", "B2", "SELECT event_id, value FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "Src IP").withColumnRenamed("props", "Flow ID")
    return C.drop_columns(e, [*V.UNUSED_COLUMNS, "ts", "event_type"])


@query("parsed_timestamps", "B3", f"""WITH {DIRTY}
SELECT event_id, rn, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM typed""")
def _(spark, sf):
    return dirty(spark, sf).select("event_id", "rn", F.date_format(
        N.parse_ts(F.col("ts_text"), SECONDS), SECONDS).alias("ts"))


@query("epoch_timestamps", "B4", f"""WITH {DIRTY}
SELECT event_id, rn, strftime(make_timestamp(TRY_CAST(epoch_text AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts
FROM dirty""")
def _(spark, sf):
    return dirty(spark, sf).select("event_id", "rn", F.date_format(N.epoch_ts(F.col("epoch_text")), SECONDS).alias("ts"))


@query("half_day_fixed", "B5", """
SELECT event_id, strftime(CASE WHEN hour(ts) < 8 THEN ts + INTERVAL 12 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS ts
FROM events""")
def _(spark, sf):
    return C.fix_half_day(table(spark, sf, "events")).select("event_id", F.date_format("ts", SECONDS).alias("ts"))


@query("made_up_timestamps", "B6", """
SELECT event_id, strftime(TIMESTAMP '2017-01-01' + to_seconds(row_number() OVER (ORDER BY event_id) - 1),
  '%Y-%m-%d %H:%M:%S') AS ts FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return C.ensure_ts(e, "2017-01-01 00:00:00", ["event_id"]).select("event_id", F.date_format("ts", SECONDS).alias("ts"))


@query("canonical_labels", "B7", f"""WITH {DIRTY} SELECT label, count(*) AS n FROM typed GROUP BY label""")
def _(spark, sf):
    d = dirty(spark, sf).select(F.col("label_text").alias("Label"))
    return C.canonical_labels(d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("category_labels", "B8", f"""WITH {DIRTY}
SELECT CASE WHEN flag = 0 OR coalesce(trim(category), '') IN ('', 'nan', 'None', 'Normal') THEN 'Benign'
            WHEN trim(category) = 'Backdoor' THEN 'Backdoors' ELSE trim(category) END AS label, count(*) AS n
FROM dirty GROUP BY ALL""")
def _(spark, sf):
    d = dirty(spark, sf).select(L.label_from_category(F.col("category"), F.col("flag")).alias("label"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("attack_names", "B9", f"""WITH {DIRTY}
SELECT CASE WHEN trim(category) IN ('', 'Normal') THEN NULL WHEN trim(category) = 'Infilteration' THEN 'Infiltration'
            ELSE trim(category) END AS attack, count(*) AS n FROM dirty GROUP BY ALL""")
def _(spark, sf):
    return dirty(spark, sf).groupBy(L.normalise_attack(F.col("category")).alias("attack")).agg(
        F.count(F.lit(1)).alias("n"))


@query("ascii_text", "B10", r"""
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (
  SELECT doc_id, regexp_replace(replace(replace(translate(text, '–—−', '---'), '→', '->'), '←', '<-'),
                                '[^\x00-\x7F]', '', 'g') AS t FROM documents)""")
def _(spark, sf):
    t = L.ascii_label(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("bigint").alias("n"))


@query("coerced_numbers", "B11", f"""WITH {DIRTY}
SELECT event_id, rn, isinf(TRY_CAST(trim(value_text) AS DOUBLE)) AS is_inf,
       CASE WHEN NOT isinf(TRY_CAST(trim(value_text) AS DOUBLE)) THEN TRY_CAST(trim(value_text) AS DOUBLE) END AS value,
       TRY_CAST(trim(k_text) AS DOUBLE) AS k FROM dirty""")
def _(spark, sf):
    d = C.coerce_numeric(dirty(spark, sf).select("event_id", "rn", F.col("value_text").alias("v"),
                                                 F.col("k_text").alias("k")), ["v", "k"])
    return d.select("event_id", "rn", (F.col("v") == float("inf")).alias("is_inf"),
                    N.finite(F.col("v")).alias("value"), "k")


@query("finite_numbers", "B12", f"""WITH {DIRTY} SELECT event_id, rn, value, k FROM typed""")
def _(spark, sf):
    return typed(spark, sf).select("event_id", "rn", "value", "k")


@query("rows_without_nulls", "B13", f"""WITH {DIRTY}
SELECT event_id, rn, value FROM typed WHERE ts IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL""")
def _(spark, sf):
    return C.apply_na_policy(typed(spark, sf), "drop", FEATURES).select("event_id", "rn", "value")


@query("nulls_to_zero", "B14 B15", f"""WITH {DIRTY}
SELECT event_id, rn, coalesce(value, 0) AS value, coalesce(k, 0) AS k FROM typed WHERE ts IS NOT NULL""")
def _(spark, sf):
    return C.apply_na_policy(typed(spark, sf), "zero", FEATURES).select("event_id", "rn", "value", "k")


@query("forward_filled", "B16", f"""WITH {DIRTY}
SELECT event_id, rn, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY label ORDER BY event_id, rn
  ROWS UNBOUNDED PRECEDING), 0) AS value FROM typed""")
def _(spark, sf):
    return C.ffill_zero(typed(spark, sf), ["value"], ["event_id", "rn"], ["label"]).select("event_id", "rn", "value")


@query("deduplicated_flows", "B17", f"""WITH {DIRTY}, d AS (
SELECT *, row_number() OVER (PARTITION BY value, k ORDER BY ts, event_id, rn, label) AS pick FROM typed WHERE ts IS NOT NULL)
SELECT event_id, rn, label, value, k FROM d WHERE pick = 1""")
def _(spark, sf):
    t = typed(spark, sf).where("ts is not null").drop("source")
    return C.dedup_flows(t, ["ts", "event_id", "rn"]).select("event_id", "rn", "label", "value", "k")


@query("deduplication_report", "B18", f"""WITH {DIRTY}, d AS (
SELECT *, row_number() OVER (PARTITION BY value, k ORDER BY ts, event_id, rn, label) AS pick FROM typed WHERE ts IS NOT NULL)
SELECT label, count(*) AS rows, count(*) FILTER (pick = 1) AS kept, count(*) FILTER (pick > 1) AS removed
FROM d GROUP BY label""")
def _(spark, sf):
    t = typed(spark, sf).where("ts is not null").drop("source")
    return C.dedup_report(t, ["ts", "event_id", "rn"])


@query("binary_labels", "B19", f"""WITH {FLOWS_SQL}
SELECT event_id, CAST(label <> 'Benign' AS INTEGER) AS is_malicious FROM flows""")
def _(spark, sf):
    return flows(spark, sf).select("event_id", L.is_malicious(F.col("label")).alias("is_malicious"))


@query("encoded_categories", "B20", f"""WITH {DIRTY},
a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT coalesce(trim(category), 'nan') AS v FROM dirty)),
b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT event_type AS v FROM dirty))
SELECT event_id, rn, a.c AS category, b.c AS event_type FROM dirty d
JOIN a ON coalesce(trim(d.category), 'nan') = a.v JOIN b ON d.event_type = b.v""")
def _(spark, sf):
    d = dirty(spark, sf).select("event_id", "rn", "category", "event_type")
    return C.encode_categories(d, ["category", "event_type"])[0]


@query("label_dictionary", "B21", f"""WITH {FLOWS_SQL}
SELECT label, CAST(CASE WHEN label = 'Benign' THEN 0 ELSE row_number() OVER (ORDER BY label = 'Benign', label) END AS BIGINT)
  AS code, n FROM (SELECT label, count(*) AS n FROM flows GROUP BY label)""")
def _(spark, sf):
    return C.label_dictionary(flows(spark, sf))


@query("encoded_labels", "B21", f"""WITH {FLOWS_SQL},
d AS (SELECT label, CASE WHEN label = 'Benign' THEN 0 ELSE row_number() OVER (ORDER BY label = 'Benign', label) END AS code
      FROM (SELECT DISTINCT label FROM flows))
SELECT event_id, CAST(code AS BIGINT) AS label_code FROM flows JOIN d USING (label)""")
def _(spark, sf):
    f = flows(spark, sf)
    return C.encode_labels(f, C.label_dictionary(f)).select("event_id", "label_code")


@query("aligned_features", "B22", "SELECT event_id, value, CAST(0 AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS extra FROM events")
def _(spark, sf):
    return C.align_features(table(spark, sf, "events").select("event_id", "value"), ["value", "k", "extra"])


CLEANED = f"""WITH {DIRTY}, fixed AS (
SELECT source, CASE WHEN hour(ts) < 8 THEN ts + INTERVAL 12 HOUR ELSE ts END AS ts, label, value, k FROM typed),
kept AS (SELECT * FROM fixed WHERE {{}}),
d AS (SELECT *, row_number() OVER (PARTITION BY source, {{}}, {{}} ORDER BY ts, label) AS pick FROM kept)
SELECT source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, label, {{}} AS "Flow Bytes/s", {{}} AS "Total Fwd Packets"
FROM d WHERE pick = 1"""


def raw_flows(spark, sf):
    return dirty(spark, sf).select(
        "source", F.col("ts_text").alias("Timestamp"), F.col("label_text").alias("Label"),
        F.col("value_text").alias("Flow Byts/s"), F.col("k_text").alias("Tot Fwd Pkts"),
        F.col("event_type").alias("Flow ID"))


@query("cleaned_flows_drop", "B23", CLEANED.format(
    "ts IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL", "value", "k", "value", "k"))
def _(spark, sf):
    df = clean_flows(raw_flows(spark, sf), CleanSpec(ts_format=SECONDS, na_policy="drop"))
    return df.withColumn("ts", F.date_format("ts", SECONDS))


@query("cleaned_flows_zero", "B23", CLEANED.format(
    "ts IS NOT NULL", "coalesce(value, 0)", "coalesce(k, 0)", "coalesce(value, 0)", "coalesce(k, 0)"))
def _(spark, sf):
    df = clean_flows(raw_flows(spark, sf), CleanSpec(ts_format=SECONDS, na_policy="zero"))
    return df.withColumn("ts", F.date_format("ts", SECONDS))


# ---- catalogue ---------------------------------------------------------------------------------------------------

@query("common_text_features", "C1", f"""WITH {DIRTY}, per AS (
SELECT event_type, count(*) FILTER (value_text IS NOT NULL AND TRY_CAST(trim(value_text) AS DOUBLE) IS NULL) AS value_text,
  count(*) FILTER (k_text IS NOT NULL AND TRY_CAST(trim(k_text) AS DOUBLE) IS NULL) AS k_text,
  count(*) FILTER (TRY_CAST(trim(label_text) AS DOUBLE) IS NULL) AS label_text FROM dirty GROUP BY event_type),
tall AS (UNPIVOT per ON value_text, k_text, label_text INTO NAME feature VALUE bad)
SELECT feature, count(*) FILTER (bad = 0) AS sources, count(*) AS total_sources,
  count(*) FILTER (bad = 0) = count(*) AS is_common FROM tall GROUP BY feature""")
def _(spark, sf):
    return K.numeric_text_features(dirty(spark, sf), ["value_text", "k_text", "label_text"], "event_type")


@query("feature_catalog", "C1 C2", """WITH c AS (SELECT CAST(o AS BIGINT) AS ordinal, f AS feature, t AS type FROM (VALUES
  (0, 'l_quantity', 'double'), (1, 'l_extendedprice', 'double'), (2, 'l_discount', 'double'), (3, 'l_tax', 'double'))
  v(o, f, t)),
n AS (SELECT count(*) AS rows, count(*) FILTER (l_quantity IS NULL) AS l_quantity, count(*) FILTER (l_extendedprice IS NULL)
  AS l_extendedprice, count(*) FILTER (l_discount IS NULL) AS l_discount, count(*) FILTER (l_tax IS NULL) AS l_tax FROM lineitem),
u AS (UNPIVOT n ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE nulls)
SELECT ordinal, feature, type, nulls, rows FROM c JOIN u USING (feature)""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    b = a.drop("l_returnflag").withColumn("only_here", F.lit(1.0))
    shared = K.common_features([a, b])
    return K.feature_catalog(a.select("l_shipdate", *shared), ["l_shipdate"]).join(K.null_census(a, shared), "feature")


@query("feature_match", "C3", """SELECT feature, feature <> 'purchase' AND feature <> 'signup' AS found
FROM (SELECT DISTINCT event_type AS feature FROM events)""")
def _(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("event_type").alias("feature")).distinct()
    wide = flows(spark, sf).select("event_id", *[F.lit(0.0).alias(c) for c in ("view", "click", "error")])
    return K.match_features(K.feature_catalog(wide), wanted)


@query("feature_match_summary", "C3", """
SELECT CAST(3 AS BIGINT) AS n_found, count(*) - 3 AS n_missing, round(3.0 / count(*), 6) AS found_ratio
FROM (SELECT DISTINCT event_type AS feature FROM events)""")
def _(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("event_type").alias("feature")).distinct()
    wide = flows(spark, sf).select("event_id", *[F.lit(0.0).alias(c) for c in ("view", "click", "error")])
    s = K.match_summary(K.match_features(K.feature_catalog(wide), wanted))
    return s.withColumn("found_ratio", F.round("found_ratio", 6))


@query("selected_features", "C3", f"""WITH {FLOWS_SQL} SELECT event_id, k, value FROM flows""")
def _(spark, sf):
    return K.select_features(flows(spark, sf), ["k", "absent", "value"], ["event_id"])


@query("clean_profile", "C4", f"""WITH {DIRTY}, d AS (
SELECT *, row_number() OVER (PARTITION BY value, k ORDER BY ts, event_id, rn) AS pick FROM typed
WHERE ts IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL)
SELECT 'raw' AS stage, label, count(*) AS rows, count(*) FILTER (value IS NULL OR k IS NULL) AS invalid_rows
FROM typed GROUP BY label
UNION ALL SELECT 'clean', label, count(*), CAST(0 AS BIGINT) FROM d WHERE pick = 1 GROUP BY label""")
def _(spark, sf):
    raw = typed(spark, sf).drop("source")
    clean = C.dedup_flows(C.apply_na_policy(raw, "drop", FEATURES), ["ts", "event_id", "rn"])
    return K.clean_profile(raw, clean, FEATURES)


@query("null_census", "C5", f"""WITH {DIRTY}
SELECT 'value' AS feature, count(*) FILTER (value IS NULL) AS nulls, count(*) AS rows FROM typed
UNION ALL SELECT 'k', count(*) FILTER (k IS NULL), count(*) FROM typed""")
def _(spark, sf):
    return K.null_census(typed(spark, sf), FEATURES)
