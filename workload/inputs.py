"""The given tables in the roles of the operators, once in Spark and once in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpane.operators import windows as win
from flowpane.operators.windows import WindowSpec

SPEC = WindowSpec(100, 20)
SMALL_SPEC = WindowSpec(20, 5)
FEATURES = ["value", "k"]
EVENT_ORDER = ["ts", "event_id"]


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: list[Query] = []


def query(name: str, survey: str, sql: str | None = None):
    """Register a query under ``name`` for a row of the operator inventory, with its SQL if it has one."""
    def add(fn):
        REGISTRY.append(Query(name, survey, fn, sql))
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as flows: a day is a source, an error or purchase of one user in fifty is an attack."""
    e = table(spark, sf, "events")
    attack = (F.col("user_id") % 50 == 7) & F.col("event_type").isin("error", "purchase")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("source"), "ts", "event_id",
        F.when(attack, F.col("event_type")).otherwise("Benign").alias("label"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def positioned(spark: SparkSession, sf: str) -> DataFrame:
    return win.position_flows(flows(spark, sf), SPEC, EVENT_ORDER)


FLOWS_SQL = """
flows AS (
  SELECT strftime(ts, '%Y-%m-%d') AS source, ts, event_id,
         CASE WHEN user_id % 50 = 7 AND event_type IN ('error', 'purchase') THEN event_type ELSE 'Benign' END AS label,
         value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n_rows FROM flows)"""

WIN_SQL = FLOWS_SQL + """,
win AS (
  SELECT *, pos - window_id * 20 AS woff FROM (
    SELECT *, unnest(generate_series(greatest(0, CAST(ceil((pos - 99) / 20.0) AS BIGINT)),
                                     least((n_rows - 100) // 20, pos // 20))) AS window_id
    FROM placed WHERE n_rows >= 100))"""

META_SQL = WIN_SQL + """,
meta0 AS (
  SELECT source, window_id, window_id * 20 AS start_idx, window_id * 20 + 100 AS end_idx, min(ts) AS start_time,
         max(ts) AS end_time, CAST(sum(CASE WHEN label <> 'Benign' THEN 1 ELSE 0 END) AS BIGINT) AS n_malicious,
         CAST(max(CASE WHEN label <> 'Benign' THEN 1 ELSE 0 END) AS INTEGER) AS is_malicious
  FROM win GROUP BY source, window_id),
attacks AS (
  SELECT source, window_id, label, count(*) AS cnt FROM win WHERE label <> 'Benign' GROUP BY ALL),
prim AS (
  SELECT source, window_id, label AS primary_attack FROM (
    SELECT *, row_number() OVER (PARTITION BY source, window_id ORDER BY cnt DESC, label) AS rn FROM attacks)
  WHERE rn = 1),
meta AS (
  SELECT m.*, p.primary_attack, row_number() OVER (ORDER BY m.source, m.window_id) - 1 AS gid
  FROM meta0 m LEFT JOIN prim p USING (source, window_id))"""

# 60/20/20 in time order
SPLIT_SQL = META_SQL + """,
cut AS (SELECT CAST(floor(count(*) * 0.6) AS BIGINT) AS a, CAST(floor(count(*) * (0.6 + 0.2)) AS BIGINT) AS b FROM meta),
split AS (
  SELECT meta.*, CASE WHEN gid < a THEN 'train' WHEN gid < b THEN 'val' ELSE 'test' END AS split FROM meta, cut)"""


def meta_frame(spark: SparkSession, sf: str, pos: DataFrame | None = None) -> DataFrame:
    """Integrated window metadata of the event flows."""
    p = positioned(spark, sf) if pos is None else pos
    return win.integrate(win.window_meta(p, SPEC), win.source_sizes(p, SPEC), SPEC)


def labelled_windows(spark: SparkSession, sf: str, pos: DataFrame | None = None) -> DataFrame:
    """Integrated windows with their label only: no row lists are built."""
    p = positioned(spark, sf) if pos is None else pos
    return win.integrate(win.window_labels(p, SPEC), win.source_sizes(p, SPEC), SPEC)
