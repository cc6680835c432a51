"""Mixing sources to target weights, in SQL functions only.

Each document gets a hash-random key. Within a source, rows are ordered by key in ranges,
the running sum of sizes is put together from sums per range (`with_prefix`), and the order
is cut at the source's exact budget; a budget above the source's size takes whole epochs
first, then cuts in the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, random_key, unused, with_prefix, word_count

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: A source is repeated this often at most.
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from one row per source with its source_size.

    The targets share the sum of all sizes by weight. One that would pass `most_epochs` times
    its source's size stops there, and the excess is shared by the others, until none passes.
    This is one level L with target = min(cap, weight * L): with the sources in order of
    cap / weight, L is what remains after the caps of those before, over the weights from
    there on, at the first source whose cap / weight reaches it. The two windows run over one
    row per source, not over documents.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(names) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("_level", rest / F.sum("weight").over(after))
    s = s.withColumn("_level", F.when(F.col("cap") / F.col("weight") >= F.col("_level"), F.col("_level")))
    level = F.first("_level", ignorenulls=True).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap")).cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source, source_size, target and taken (words).

    Size is the number of words; a null text has none. A null source is a source of its own,
    the last one. A source's taken words add up to its target, rounded to a word: every
    document is taken in each whole epoch, and the last, partial epoch takes documents in key
    order up to the exact word, so that one document of a source is taken in part. Rows that
    repeat an id are documents of their own; whole repeated rows are interchangeable.
    """
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    sized = cut(sized.withColumn("_key", random_key(F.lit(seed), F.col("_id"), F.col("size"))))
    sizes = cut(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("_rows")))
    counted = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.count("*").alias("sources")).first()
    targets = cut(source_targets(sizes.select("source", "source_size"))).withColumnRenamed("source", "_source")
    placed = with_prefix(sized, "source", "_key", ["_id", "size"], "size", "_prefix", counted["rows"])
    if counted["sources"] <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    out = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    part = budget - epochs * F.col("source_size") - F.col("_prefix")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns unchanged.

    Every row stands for itself, with whatever id or none. The row at a source's cut counts as
    whole if half of its words or more are taken, so a source's words differ from its target by
    half a document at most. A row without words costs nothing and is kept once.

    Only keys and sizes are shuffled: they give one cut for each source, the place in the order of
    keys up to which the last epoch goes, and each row is then decided where it is read. Rows
    that agree in all columns have one place; those at a cut are counted and so many put out.
    """
    names = {n: unused(docs, f"_{n}") for n in ("source", "size", "key", "hash", "end", "copies")}
    source, size, key, hashed, end, copies = names.values()
    plain = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes]
    rows = docs.withColumns({source: F.col(source_col).cast("string"), size: word_count(F.col(text_col)), hashed: F.xxhash64(*plain)})
    rows = rows.withColumn(key, random_key(F.lit(seed), F.col(id_col), F.col(size)))

    groups = cut(rows.groupBy(F.col(source).alias("source"), F.col(key).alias("key"), F.col(hashed).alias("hash"), F.col(size).alias("size")).agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n")))
    sizes = cut(groups.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"), F.count("*").alias("rows")))
    counted = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("sources")).first()
    targets = source_targets(sizes.select("source", "source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(targets.select(F.col("source").alias("_source"), epochs.alias("epochs"), (F.round("target").cast("long") - epochs * F.col("source_size")).alias("rest")))
    few = counted["sources"] <= BROADCAST_ROWS
    placed = with_prefix(groups, "source", "key", ["hash", "size"], "words", "before", counted["rows"])
    placed = placed.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("_source")))
    # The group of equal rows in which the last epoch ends: at most one for each source.
    left = F.col("rest") - F.col("before")
    at = placed.filter((F.col("size") > 0) & (left >= 0) & (left < F.col("words"))).withColumn("whole", F.floor((2 * left + F.col("size")) / (2 * F.col("size"))).cast("long"))
    cuts = targets.join(at.select(F.col("source").alias("_at"), "key", "hash", "size", "whole"), F.col("_source").eqNullSafe(F.col("_at")), "left")
    cuts = cut(cuts.select(F.col("_source"), F.col("epochs"), F.struct("key", "hash", "size").alias("_cut"), F.coalesce("whole", F.lit(0)).alias("_whole"), F.col("key").isNotNull().alias("_some")).select(F.struct("*").alias(end)))

    place = F.struct(F.col(key).alias("key"), F.col(hashed).alias("hash"), F.col(size).alias("size"))
    told = rows.join(F.broadcast(cuts) if few else cuts, F.col(source).eqNullSafe(F.col(end)["_source"]))
    here = (F.col(size) > 0) & F.col(end)["_some"] & (place == F.col(end)["_cut"])
    before = F.col(end)["_some"] & (place < F.col(end)["_cut"])
    times = F.when(F.col(size) == 0, 1).otherwise(F.col(end)["epochs"] + F.when(before, 1).otherwise(0)).cast("int")
    own = [F.col(c) for c in docs.columns]
    many = lambda df, n: df.filter(n > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), n)))
    most = many(told.filter(~here), times).select(*own)
    some = told.filter(here).groupBy(source, key, hashed, size).agg(F.first(F.struct(*own)).alias(end + "r"), (F.first(F.col(end)["epochs"]) * F.count("*") + F.first(F.col(end)["_whole"])).cast("int").alias(end))
    return most.unionByName(many(some, F.col(end)).select(f"{end}r.*"))


def oracle() -> str:
    """DuckDB SQL of the plan's columns."""
    return """
WITH sized AS (
  SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 15))::BIGINT AS k
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT lv FROM l WHERE cap / weight >= lv ORDER BY cap / weight LIMIT 1))::DOUBLE AS target FROM l
), p AS (
  SELECT sized.*, source_size, target, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - pre)) ELSE 0 END)::BIGINT AS taken
FROM p"""
