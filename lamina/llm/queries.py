"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_quotes, decontamination, license_scan, mixing, near_duplicates, previous_factors, quality_rules, recompression, sharding, token_counts
from .common import Scratch
from .sql import ORACLES

NAMES: dict = {}


def query(f):
    NAMES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_quotes.formatted(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "n_quotes", "max_level", "parent_turn", "thread_turn", "depth", "position", "clean_text", "quotes")


@query
def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    # the range exchange looks at its input twice: texts are read once, for these three numbers
    sized = Scratch(spark).table("sized", sized)
    out = sharding.sharded(sized, "doc_id", "text_crc32", "size", shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.labelled(table(spark, sf_dir, "documents"))


@query
def op5_learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    numbers = quality_rules.with_statistics(docs).drop("text")
    out, _ = quality_rules.judged(numbers, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


@query
def op8_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = previous_factors.deduplicated(table(spark, sf_dir, "documents"), remove="all")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.per_row(decontamination.judged(docs, table(spark, sf_dir, "benchmark")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return dict(NAMES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in NAMES}
