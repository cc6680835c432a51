"""Sharding by weighted rendezvous hashing of stable record keys, in SQL functions only.

A record's score for a shard depends on its key, the shard's number and the shard's weight
alone, and the record goes to the shard with the highest score. A further shard changes no
score of the others, so records move only into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, random_key, with_prefix


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key. Score: -weight / ln(u), u even in (0, 1) by hash of key and shard.

    This gives shares in proportion to the weights. With equal weights the order of the
    scores is that of u, which is then compared as it is.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    even = len(set(weights)) == 1
    scores = []
    for shard, weight in enumerate(weights):
        u = random_key(key, F.lit(shard))
        score = u if even else F.lit(-float(weight)) / F.ln((u + 0.5) / float(2**60))
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def shard_plan(docs: DataFrame, weights: Sequence[float] = (1,) * 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot and grown_shard.

    Size is the text's UTF-8 bytes plus 1; a null text has none and the CRC of the empty
    text. The slot numbers a shard's rows from 0 without gaps, in hash order. grown_shard is
    the shard with one more of the first one's weight. Rows without an id share one key, and
    rows that repeat an id share a shard; each has its own slot.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col("_id")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({
        "shard": rendezvous(key, weights),
        "grown_shard": rendezvous(key, (*weights, weights[0])),
        "_key": random_key(F.lit("slot"), key, F.col("text_crc32"), F.col("size")),
        "_one": F.lit(1),
    })
    rows = cut(rows)
    placed = with_prefix(rows, "shard", "_key", ["_id", "size", "text_crc32"], "_one", "slot", rows.count())
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1,) * 8, id_col: str = "doc_id") -> DataFrame:
    """`docs` with its shard, in one pass without a shuffle (a column `shard` there is replaced)."""
    return docs.withColumn("shard", rendezvous(F.col(id_col), weights))

