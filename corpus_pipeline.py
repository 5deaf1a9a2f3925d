"""From documents to token ids: toxic documents and near copies go, personal data is redacted, sources are mixed, texts encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one. All but
the last return the columns of ``documents``; after mixing, a document comes as often as its source's weight says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowpane.llm import byte_bpe, mixing, personal_data, simhash, toxicity
from flowpane.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).drop(*mixing.ADDED)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: The fitted models and the tokeniser are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
