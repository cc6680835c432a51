"""The thin queries of the corpus operators: each runs one over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, hard_negatives, link_trust, mixing, packing, piece_bpe, sharding, simhash_dedup, surrogates, token_counts, toxicity, turn_repair
from .common import table

#: The key of the registered query only; real runs pass a secret of their own.
SURROGATE_KEY = "example key"


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge_urls(table(spark, sf_dir, "pages")).drop("by_rule")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


def op12_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.token_digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_tokens": op1_pack_tokens,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_surrogates": op6_surrogates,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix_sources": op8_mix_sources,
    "op9_url_filter": op9_url_filter,
    "op10_shard": op10_shard,
    "op11_repair_turns": op11_repair_turns,
    "op12_piece_tokens": op12_piece_tokens,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op8_mix_sources": mixing.oracle()}
