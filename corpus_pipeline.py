"""From raw documents to balanced shards: five stages, each an operator of colguard.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colguard.llm import decontaminate, language_id, mixing, near_dedup, sharding
from colguard.llm.common import Scratch


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects. Learns from the documents' own lang, all rows."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row."""
    return sharding.assign(docs)


STAGES = [("language_id", languages), ("near_dedup", near_copies), ("decontamination", benchmark), ("mixing", mixture), ("sharding", shards)]

#: Models and components can't be put in SQL; tests hold each stage against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, name)
    return docs
