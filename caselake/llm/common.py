"""What several corpus operators share: cutting lineage, components, hot keys, positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import reachable

#: The six ASCII space characters that separate words in the contracts.
SPACE = "[\\x20\\x09-\\x0D]+"


#: A table of narrow rows is broadcast only if it is counted to have this many at most.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the session's ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        _folders[app] = f"{folder.rstrip('/')}/{app}"
    return _folders[app]


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it: lineage ends there, and the planner knows its true size.

    (A checkpoint keeps the estimated size, which each join multiplies: after some rounds of
    `components` planning alone took minutes.)
    """
    spark = reachable(df.sparkSession)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders in the shared folder, by whatever file system it is in."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the ASCII spaces; 0 for null."""
    words = F.split(F.regexp_replace(text, f"^{SPACE}|{SPACE}$", ""), SPACE)
    return F.when(F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), F.size(words)).otherwise(0).cast("long")


def random_key(*cols: Column) -> Column:
    """A 60-bit number from MD5 of the columns' text: even over its range, the same in any engine."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_prefix(df: DataFrame, group: str, key: str, ties: list[str], value: str, out: str, rows: int, per_range: int = 2_000) -> DataFrame:
    """Add `out`: the sum of `value` over the rows that stand before this one in its group.

    The order in a group is by `key` (a `random_key`, so its ranges hold equal shares), then
    `ties`. The key's range is cut into as many parts as `rows` needs; a part is summed and
    sorted by itself, and only the parts' sums are added up along a group, so that a group
    that holds most rows is spread like any other. Rows that agree in key and all of `ties`
    are interchangeable.
    """
    parts = max(1, -(-rows // per_range))
    df = df.withColumn("_part", F.floor(F.col(key) / F.lit(float(2**60)) * parts).cast("int"))
    sums = df.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    df = df.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")), "left")
    return df.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_group", "_at", "_before")


def split_hot(df: DataFrame, key: str, member: str, most: int, keep_chunk: bool = False) -> DataFrame:
    """Add `lo` and `hi`, so that the rows of each (key, lo, hi) number about 2 * `most` at most.

    A key with up to `most` rows keeps them together as (0, 0). The members of a larger one
    are dealt into chunks, and each two chunks meet once, so that every pair of a key's rows
    still meets: with `lo` = `hi` inside a chunk, else across. The large keys are broadcast
    only if they are counted as few.
    """
    big = df.groupBy(key).count().filter(F.col("count") > most)
    big = cut(big.select(F.col(key).alias("_big"), F.ceil(F.col("count") / most).cast("int").alias("_n")))
    keys = big.count()
    if keys == 0:
        return df.withColumns({c: F.lit(0) for c in ("lo", "hi", *["_chunk"] * keep_chunk)})
    df = df.join(F.broadcast(big) if keys <= BROADCAST_ROWS else big, F.col(key) == F.col("_big"), "left")
    chunk = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("chunk"), F.col(member)), F.col("_n"))).cast("int")
    df = df.withColumn("_chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
    return df.withColumns({"lo": F.least("_chunk", "_other"), "hi": F.greatest("_chunk", "_other")}).drop("_big", "_n", "_other", *["_chunk"] * (not keep_chunk))


#: A task thins so many edges at once.
THIN_EDGES = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), for the nodes of the edges that are not themselves the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), np.split(at, 2)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def thin(edges: DataFrame) -> DataFrame:
    """Fewer edges (a long, b long) with the same components: each task draws stars for those it holds, `THIN_EDGES` at a time."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.to_numpy())
            n += len(batch)
            if n >= THIN_EDGES:
                yield pd.DataFrame(dict(zip("ab", stars(*np.concatenate(held).T), strict=True)))
                held, n = [], 0
        if n:
            yield pd.DataFrame(dict(zip("ab", stars(*np.concatenate(held).T), strict=True)))

    # Tasks that hold few edges find few that others make needless.
    return edges.select("a", "b").coalesce(max(1, -(-edges.count() // THIN_EDGES))).mapInPandas(drawn, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long): node, component (its smallest node).

    Edges that a task finds needless go first (`thin`). Each round, every node moves to its smallest neighbour if that is smaller, then twice to
    where its place has moved, and the edges are drawn anew between the places. A node moves
    along edges only, to smaller nodes only, so components stay whole and end at their
    smallest node; the edges shrink by a factor each round and are gone in the end.
    Labels and edges are tables in the shared folder, so that both sides of a join come
    straight from an exchange and a node with many edges can be split.
    """
    # Written before it is turned round: worked out twice, a forest may come out as two different ones.
    e = cut(thin(cut(edges.filter("a <> b").select("a", "b"))))
    e = cut(e.union(e.select("b", "a")).distinct())
    label = None
    for _ in range(most_rounds):
        if e.isEmpty():
            break
        move = cut(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
        twice = _then(move, move)
        move = cut(_then(twice, twice))
        label = move if label is None else cut(_then(label, move))
        at = lambda end: move.select(F.col("node").alias(f"_{end}"), F.col("root").alias(f"{end}_root"))
        e = e.join(at("a"), F.col("a") == F.col("_a")).join(at("b"), F.col("b") == F.col("_b"))
        e = cut(e.filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.withColumnRenamed("root", "component")


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, root): where `second` takes the root that `first` gives; roots it does not know stay."""
    go = second.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    return first.join(go, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))
