"""The corpus pipeline: documents through five operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
stored and reread as the next one's ``docs``. All but the last return the
columns of documents:

language_id     rejects documents without letters or without a likely language
near_dedup      keeps the first document of each near-duplicate group
decontaminate   rejects documents that hold a benchmark item
mix             emits every document as often as its source's rate says
shard           adds the shard (and the one after one more is added)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderdesk.llm import decontam, langid, minhash, mixing, sharding
from orderdesk.llm.common import checkpointed, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return (sharding.placed(docs).withColumns({"shard": F.col("__shard"), "grown_shard": F.col("__grown_shard")})
            .drop("__shard", "__grown_shard", "__size", "__crc32"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]

# The network and the edit distances cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the shared checkpoint folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
