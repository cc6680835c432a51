"""The corpus pipeline: documents in, deduplicated, mixed and sharded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stage's result is
written as Parquet and read again as the next one's docs. The first four return the columns
of documents. Mixing repeats rows, one for each time that the mix takes the document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from caselake.llm import decontamination, mixing, sharding, shingle_dedup, simhash_dedup, toxicity
from caselake.llm.common import delete, shared_folder, table

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents whose 5-word shingles are alike to 0.8 or more, the one with the smallest id stays."""
    return simhash_dedup.drop_near_duplicates(docs, classes=shingle_dedup.similar_duplicates)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight takes them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard, in a new column."""
    return sharding.assign_shards(docs, (1,) * SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: A classifier that is learned decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the cluster's shared folder and read again; a stage's input goes when its result is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
