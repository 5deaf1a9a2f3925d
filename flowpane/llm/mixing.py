"""Mixing sources by temperature: weights are token shares to a power, realised as budgeted block permutations.

With the power a, source s gets a weight in proportion to p_s ** a. Output is sized so that the most reduced source is still
given whole: a source is repeated (p_max / p_s) ** (1 - a) times, where p_max stands for the least repeated. The power is
bisected until the entropy of the weights, or the largest repetition, meets its target. Each pass of a source is a seeded
permutation of its documents, the last one cut at the source's budget of tokens, and every block of the output gets of each
source what its weight says.

A document's tokens are its stretches between blanks, tabs and line ends, counted by those separators. Defined results: a
null or empty text has 0 tokens and goes with the document before it in its permutation; a null source counts as the source
''; sources without tokens are given once; repeated rows are documents of their own; an empty table gives an empty result.
Added columns are called mix_copy, mix_block, mix_place; columns of the input with those names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowpane.llm.common import stage, text_or_empty

SEED = 42
REPETITION_LIMIT = 1.25
BLOCK_TOKENS = 262_144
#: Steps of the bisection, and how many of them one job takes.
BISECTIONS, AT_ONCE = 40, 5
ADDED = ("mix_copy", "mix_block", "mix_place")


def separator_tokens() -> Column:
    text = text_or_empty()
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " \t\n\r", "")) + 1).cast("long")


def _measured(sources: DataFrame, powers: list[float]) -> dict[float, tuple[float, float]]:
    """(entropy of the weights, largest repetition) at each power."""
    rows = (sources.withColumn("a", F.explode(F.array(*[F.lit(a) for a in powers])))
            .withColumn("w", F.pow(F.col("share"), F.col("a")))
            .groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"),
                              F.max(F.pow(F.col("top") / F.col("share"), 1 - F.col("a"))).alias("most")).collect())
    return {r["a"]: (math.log(r["z"]) - r["wl"] / r["z"], r["most"]) for r in rows}


def find_power(sources: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None) -> float:
    """The largest flattening (least power in 0..1) within the limit, or the power at which the weights have ``entropy``.

    Both measures fall as the power grows, so the bracket is halved; a job evaluates the midpoints of several halvings.
    """
    low, high = 0.0, 1.0
    fine = (lambda m: m[1] <= repetition_limit) if entropy is None else (lambda m: m[0] <= entropy)
    for _ in range(BISECTIONS // AT_ONCE):
        parts = 1 << AT_ONCE
        inner = [low + (high - low) * k / parts for k in range(1, parts)]
        measured = _measured(sources, inner)
        if not measured:
            return 1.0
        a, b = 0, parts
        while b - a > 1:  # the same halvings, looked up
            mid = (a + b) // 2
            a, b = (a, mid) if fine(measured[inner[mid - 1]]) else (mid, b)
        low, high = low + (high - low) * a / parts, low + (high - low) * b / parts
    return high


def mix(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None,
        tokens: Column | None = None, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, each as often as its source's weight says, with the copy's number, block and place.

    mix_copy counts passes from 0; mix_block is the block of the output; mix_place is how many tokens of the source come
    before. Within a block the order is that of mix_place over the source's tokens in the block, so sources alternate.
    Sums over a hot source are taken over buckets of its permutation; no window spans a source.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*kept, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
                       (separator_tokens() if tokens is None else tokens).alias("__tokens"),
                       F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text_or_empty())).alias("__key"))
    sizes = stage(rows.groupBy("__source").agg(F.sum("__tokens").alias("size"), F.count(F.lit(1)).alias("n")), "sizes")
    total, n, most = sizes.agg(F.sum("size"), F.sum("n"), F.max("size")).first()
    total, n, top = total or 0, n or 0, (most or 0) / (total or 1)
    sources = stage(sizes.filter("size > 0").select("__source", "size", (F.col("size") / F.lit(float(total or 1))).alias("share"), F.lit(top).alias("top")),
                    "shares")
    power = find_power(sources, repetition_limit, entropy)
    times = F.pow(F.col("top") / F.col("share"), F.lit(1 - power))
    planned = sources.select("__source", "size", F.round(times * F.col("size")).cast("long").alias("budget"))
    output = planned.agg(F.sum("budget")).first()[0] or 0
    planned = stage(sizes.select("__source").join(planned, "__source", "left").select(
        "__source", F.coalesce("size", F.lit(0)).alias("__size"), F.coalesce("budget", F.lit(0)).alias("__budget"),
        F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("size"))).cast("int").alias("__copies"),
        F.greatest(F.lit(1.0), F.col("budget") * F.lit(float(block_tokens)) / F.lit(float(output or 1))).alias("__portion")), "plan")
    digits = max(1, math.ceil(math.log(max(n, 1) / 2000 + 1, 16)))
    copies = (rows.join(planned, "__source")
              .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)))
              .withColumn("__order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("mix_copy").cast("string"), "__key")))
              .withColumn("__bucket", F.substring("__order", 1, digits)))
    cell = ["__source", "mix_copy", "__bucket"]
    over = Window.partitionBy("__source", "mix_copy").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(copies.groupBy(*cell).agg(F.sum("__tokens").alias("sum"))
                   .select(*cell, F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("__start")), "starts")
    inside = Window.partitionBy(*cell).orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    placed = (copies.withColumn("__inside", F.coalesce(F.sum("__tokens").over(inside), F.lit(0)))
              .join(starts, cell)
              .withColumn("mix_place", F.col("mix_copy") * F.col("__size") + F.col("__start") + F.col("__inside")))
    taken = (F.col("mix_place") < F.col("__budget")) | ((F.col("mix_copy") == 0))
    return placed.filter(taken).withColumn("mix_block", F.floor(F.col("mix_place") / F.coalesce("__portion", F.lit(1.0))).cast("long")) \
        .select(*kept, *ADDED)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", *ADDED)


SQL = f"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT doc_id, source, coalesce(source, '') AS src,
         CASE WHEN coalesce(text, '') = '' THEN 0
              ELSE length(text) - length(translate(text, ' ' || chr(9) || chr(10) || chr(13), '')) + 1 END AS n,
         coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, '')) AS key
  FROM documents),
sizes AS MATERIALIZED (SELECT src, CAST(sum(n) AS BIGINT) AS size FROM rows GROUP BY src),
shares AS MATERIALIZED (
  SELECT src, size, size / CAST(sum(size) OVER () AS DOUBLE) AS share,
         max(size) OVER () / CAST(sum(size) OVER () AS DOUBLE) AS top
  FROM sizes WHERE size > 0),
halved(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN fine THEN low ELSE mid END, CASE WHEN fine THEN mid ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid,
               (SELECT max(pow(s.top / s.share, 1 - (low + high) / 2)) FROM shares s) <= {REPETITION_LIMIT} AS fine
        FROM halved WHERE step < {BISECTIONS})),
power AS (SELECT high AS a FROM halved WHERE step = {BISECTIONS}),
budgets AS (SELECT src, size, CAST(round(pow(top / share, 1 - a) * size) AS BIGINT) AS budget FROM shares, power),
plan AS MATERIALIZED (
  SELECT z.src, coalesce(b.size, 0) AS size, coalesce(b.budget, 0) AS budget,
         coalesce(greatest(1, CAST(ceil(b.budget / b.size) AS INTEGER)), 1) AS copies,
         coalesce(greatest(1, b.budget * CAST({BLOCK_TOKENS} AS DOUBLE) / (SELECT CAST(sum(budget) AS DOUBLE) FROM budgets)), 1) AS portion
  FROM sizes z LEFT JOIN budgets b USING (src)),
placed AS (
  SELECT doc_id, source, copy, budget, portion,
         copy * size + coalesce(sum(n) OVER (PARTITION BY src, copy ORDER BY md5('{SEED}|' || copy || '|' || key)
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM (SELECT r.*, p.size, p.budget, p.portion, unnest(range(p.copies)) AS copy FROM rows r JOIN plan p USING (src)))
SELECT doc_id, source, CAST(copy AS INTEGER) AS mix_copy, CAST(floor(place / portion) AS BIGINT) AS mix_block, CAST(place AS BIGINT) AS mix_place
FROM placed WHERE place < budget OR copy = 0
"""
