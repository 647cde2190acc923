"""The training-data pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last adds law, shard, slot and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilark.llm import decontaminate, jaccard, language, mixing, queries, shard
from vigilark.llm.common import stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that holds at least three tenths of their letters."""
    return language.keep_identified(docs, queries.language_model(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Returns each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    return shard.with_shards(docs)


STAGES = [
    ("language", identified), ("near_copies", deduplicated), ("decontamination", decontaminated),
    ("mixing", mixed_sources), ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


ORACLE_SQL = None  # trained languages and drawn copies are not SQL; tests/llm holds it against brute force
