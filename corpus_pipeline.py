"""The corpus pipeline: five of the operators in a row, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`; the last adds where a
row goes. Stages are written as Parquet and read again, so each starts with short lineage. Extra columns
are carried along; the last stage's shard and slot take the place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from lamina.llm.common import Scratch

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned list."""
    return quality_rules.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.expanded(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a global shuffle, dealt to shards; with shard and slot."""
    scratch = Scratch(spark)
    return sharding.sharded(docs, "doc_id", F.crc32("text"), shards=SHARDS, keep=lambda df: scratch.table("rows", df))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("weighted_mix", mix), ("feistel_sharding", shard)]

#: SQL can't express the learned rules; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(name, docs)
    return docs
