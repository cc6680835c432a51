"""Queries of streams and files: rows that arrive in two parts, run to the end, against the batch's SQL; files that Spark writes, read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import chunks as C
from ..sources import readers, sinks
from ..streaming import streams as T
from . import views as V
from .registry import ORACLES, query

#: State of arbitrary processors needs this store; empty batches, which only fire timers, are left out.
STREAMING = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
FILES = 4


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arriving(df: DataFrame, early: Column) -> DataFrame:
    """A stream of the rows of `df`: the early ones come first, the others in a later batch."""
    spark = df.sparkSession
    path = scratch(spark, "arriving")
    df.filter(early).repartition(FILES).write.parquet(path)
    df.filter(~early).repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its input is read, with the number of the batch that gave it."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    with settings(spark, STREAMING):
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "progress")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch int").option("recursiveFileLookup", "true").parquet(out)


@query("t1_stream_records", f"WITH {V.CATALOG} SELECT CASE WHEN doc_id % 10 > 0 THEN id END AS id, CASE WHEN doc_id % 10 > 0 THEN source_path END AS source_path, doc_id % 10 = 0 AS bad_line FROM catalog WHERE doc_id % 7 > 0 OR doc_id % 10 = 0")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, some torn, some without an id."""
    n = F.col("doc_id")
    line = F.to_json(F.struct(F.when((n % 7 > 0) | (n % 10 == 0), F.col("id")).alias("id"), "source_path"))
    path = scratch(spark, "lines")
    V.catalog(spark, sf_dir).select(F.when(n % 10 == 0, F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    return to_end(T.stream_records(spark, path)).select(F.when(~F.col("bad_line"), F.col("id")).alias("id"), F.when(~F.col("bad_line"), F.col("source_path")).alias("source_path"), "bad_line")


@query("t2_stream_overlay", f"SELECT id, source_path, sha256 FROM ({ORACLES['j9_live_overlay']})")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    base, out = scratch(spark, "base"), scratch(spark, "overlay")
    a.select(F.col("doc_id").alias("ord"), "id", "source_path", "sha256").write.parquet(base)
    live = b.select(F.col("doc_id").alias("line_no"), F.when((F.col("doc_id") + 1) % 10 == 7, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), "source_path", "sha256")
    q = T.stream_overlay(arriving(live, F.col("line_no") % 4 > 0), base, out, scratch(spark, "progress"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return T.overlay_snapshot(spark, out, base).select("id", "source_path", "sha256")


@query("t3_stream_chain_check", """WITH l AS (SELECT conv_id AS lane, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS line_no, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT lane, line_no, CASE WHEN (lane % 5 = 0 AND line_no >= 2) OR (lane % 8 IN (3, 4, 5) AND line_no = k) THEN 'broken' ELSE 'intact' END AS state FROM l""")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of each lane come before the others; tails as in w15."""
    lines = V.lane_lines(spark, sf_dir, tails=True).withColumn("lane", F.col("lane").cast("string"))
    return to_end(T.stream_chain_check(arriving(lines, F.col("line_no") <= 3))).select(F.col("lane").cast("long").alias("lane"), "line_no", "state")


@query("t4_stream_gap_findings", ORACLES["w2_frame_gap_findings"])
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    middle = frames.agg(F.expr("max(offset) div 2")).first()[0] or 0
    return to_end(T.stream_gap_findings(arriving(frames, F.col("offset") <= middle))).drop("batch")


@query("t5_stream_job_state", f"WITH {V.JOBS} SELECT job, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(units, seq) AS units FROM jobs GROUP BY job")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = to_end(T.stream_job_state(arriving(V.job_events(spark, sf_dir), F.col("seq") % 3 == 0), timeout_ms=3_600_000), "update")
    return states.groupBy("job").agg(F.max_by(F.struct("seq", "status", "units"), "batch").alias("s")).select("job", "s.*")


@query("t6_stream_known_hash", f"WITH {V.CATALOG}, {V.KNOWN} SELECT id, CASE WHEN c.sha256 IS NULL THEN 'unhashed' WHEN k.sha256 IS NOT NULL THEN 'known' ELSE 'unknown' END AS hash_class FROM catalog c LEFT JOIN known k ON c.sha256 = k.sha256")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = arriving(V.catalog(spark, sf_dir), F.col("doc_id") % 2 == 0)
    return to_end(T.stream_known_hash(live, V.known_hashes(spark, sf_dir))).select("id", "hash_class")


FILE = "regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g')"


def _source_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each source, a line for each document."""
    root = scratch(spark, "files")
    d = V.table(spark, sf_dir, "documents").select("source", "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("value"))
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").option("lineSep", "\n").text(root)
    return root


@query("s2_catalog_files", f"SELECT source, extension, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, max(sha256) AS sha256 FROM (SELECT source, 'txt' AS extension, sum(strlen({FILE}) + 1) AS size_bytes, sha256(string_agg({FILE} || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source) GROUP BY 1, 2")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = readers.catalog_files(spark, _source_files(spark, sf_dir), extensions=("txt",), with_hash=True)
    return files.groupBy(F.regexp_extract("relative_path", "source=([^/]*)/", 1).alias("source"), "extension").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.max("sha256").alias("sha256"))


@query("s3_read_chunks", f"SELECT source, (size + 65535) // 65536 AS chunks, size FROM (SELECT source, sum(strlen({FILE}) + 1)::BIGINT AS size FROM documents GROUP BY source)")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = C.read_chunks(spark, _source_files(spark, sf_dir), chunk=1 << 16).filter(F.col("image").endswith(".txt"))
    rows = read.select(F.regexp_extract("image", "source=([^/]*)/", 1).alias("source"), (F.col("start_b") + F.octet_length("bytes")).alias("until"))
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.max("until").alias("size"))


@query("s7_read_annotations", f"WITH {V.MARKS} SELECT id, status, 1700000000 + substr(id, 5)::BIGINT AS marked_unix FROM marks WHERE (substr(id, 5)::BIGINT // 100) % 5 > 0 AND substr(id, 5)::BIGINT % 11 > 0")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each hundred records; every fifth belongs to another case, and some marks have an unknown status."""
    n = F.substr(F.col("id"), F.lit(5)).cast("long")
    m = V.marks(spark, sf_dir).withColumns({"n": n, "page": F.expr("cast(substr(id, 5) as long) div 100")})
    mark = F.struct("id", F.when(F.col("n") % 11 > 0, F.col("status")).otherwise("odd").alias("status"), (F.col("n") + 1_700_000_000).alias("marked_unix"))
    docs = m.groupBy("page").agg(F.collect_list(mark).alias("marks"))
    docs = docs.select("page", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.when(F.col("page") % 5 > 0, "mine").otherwise("other").alias("case_id"), "marks")).alias("value"))
    path = scratch(spark, "annotations")
    docs.repartition("page").write.partitionBy("page").text(path)
    return readers.read_annotations(spark, path, "mine")[0].select("id", "status", "marked_unix")


@query("s11_write_index", f"WITH {V.CATALOG} SELECT id, source_path, size_bytes, modified_unix, sha256 FROM catalog")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "index")
    c = V.catalog(spark, sf_dir).select("id", "source_path", F.col("source_path").alias("relative_path"), "size_bytes", "modified_unix", "sha256", F.lit(False).alias("stale"))
    sinks.write_index(c, path)
    return readers.read_records(spark, f"{path}/videos.jsonl")[0].select("id", "source_path", "size_bytes", "modified_unix", "sha256")
