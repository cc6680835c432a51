"""The driver's tables in the shapes of an evidence catalog: for Spark, and as DuckDB SQL."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lanes import GENESIS
from ..session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def record_id(n):
    return F.format_string("vid_%06d", n + 1)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog records: id, parent_dir, source_path, extension, size_bytes, modified_unix, sha256, lang, source, doc_id."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "avi", "mov", "dav", "ts"))), (n % 5 + 1).cast("int"))
    parent = F.concat(F.lit("/evidence/"), F.col("source"), F.lit("/"), F.col("lang"))
    shift = F.when(n % 11 == 0, -864000).when(n % 13 == 0, 864000).otherwise(0)
    return d.select(
        record_id(n).alias("id"), parent.alias("parent_dir"),
        F.concat(parent, F.lit("/clip_"), F.lpad(n.cast("string"), 6, "0"), F.lit("."), ext).alias("source_path"), ext.alias("extension"),
        F.col("n_chars").alias("size_bytes"), F.when(n % 17 != 0, 1704067200 + n * 3600 + shift).alias("modified_unix"),
        F.when(n % 7 != 0, F.sha2("text", 256)).alias("sha256"), "lang", "source", n.alias("doc_id"),
    )


CATALOG = """catalog AS (
  SELECT printf('vid_%06d', doc_id + 1) AS id, '/evidence/' || source || '/' || lang AS parent_dir,
         '/evidence/' || source || '/' || lang || '/clip_' || lpad(doc_id::VARCHAR, 6, '0') || '.' || ext AS source_path, ext AS extension,
         n_chars AS size_bytes,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1704067200 + doc_id * 3600 + CASE WHEN doc_id % 11 = 0 THEN -864000 WHEN doc_id % 13 = 0 THEN 864000 ELSE 0 END END AS modified_unix,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS sha256, lang, source, doc_id
  FROM (SELECT *, ['mp4', 'avi', 'mov', 'dav', 'ts'][(doc_id % 5 + 1)::INTEGER] AS ext FROM documents))"""


def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.upper(F.sha2("text", 256)).alias("sha256")).distinct()


KNOWN = "known AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 3 = 0)"


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two catalogs that share most records; some moved, some changed."""
    c = catalog(spark, sf_dir)
    k = (F.col("doc_id") + 1) % 10
    b = c.filter(k >= 2).withColumns({
        "source_path": F.when(k == 5, F.concat("source_path", F.lit(".moved"))).otherwise(F.col("source_path")),
        "sha256": F.when(k == 6, F.sha2("sha256", 256)).otherwise(F.col("sha256")),
    })
    return c.filter(k < 8), b


CASES = CATALOG + """, case_a AS (SELECT * FROM catalog WHERE (doc_id + 1) % 10 < 8), case_b AS (
  SELECT * REPLACE (CASE WHEN (doc_id + 1) % 10 = 5 THEN source_path || '.moved' ELSE source_path END AS source_path,
                    CASE WHEN (doc_id + 1) % 10 = 6 THEN sha256(sha256) ELSE sha256 END AS sha256)
  FROM catalog WHERE (doc_id + 1) % 10 >= 2)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("camera"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_s"), F.round(F.col("value") * 60, 3).alias("duration_s"))


SEGMENTS = "segments AS (SELECT user_id AS camera, event_id AS id, floor(epoch(ts))::BIGINT AS start_s, round(value * 60, 3) AS duration_s FROM events)"


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 4096 + F.col("l_orderkey") % 64
    return l.select(F.col("l_suppkey").alias("image"), start.alias("start_b"), (start + F.col("l_quantity").cast("long") * 64).alias("end_b"))


CLAIMED = "claimed AS (SELECT l_suppkey AS image, l_partkey * 4096 + l_orderkey % 64 AS start_b, l_partkey * 4096 + l_orderkey % 64 + l_quantity::BIGINT * 64 AS end_b FROM lineitem)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.when(F.col("event_id") % 29 != 0, F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.select(F.col("user_id").alias("file"), (F.col("event_id") % 3).alias("channel"), F.col("event_id").alias("offset"), seconds.alias("seconds"))


FRAMES = "frames AS (SELECT user_id AS file, event_id % 3 AS channel, event_id AS \"offset\", CASE WHEN event_id % 29 = 0 THEN NULL ELSE floor(epoch(ts))::BIGINT END AS seconds FROM events)"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "important").when(F.col("quality") == 1, "reviewed").otherwise("needs_verification")
    return table(spark, sf_dir, "labels").select(record_id(F.col("doc_id")).alias("id"), status.alias("status"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.array_compact(F.array(F.when(F.col("toxic") == 1, "flag"), F.when(F.col("quality") == 1, "good")))
    return table(spark, sf_dir, "labels").select(record_id(F.col("doc_id")).alias("id"), have.alias("tags"))


MARKS = "marks AS (SELECT printf('vid_%06d', doc_id + 1) AS id, CASE WHEN toxic = 1 THEN 'important' WHEN quality = 1 THEN 'reviewed' ELSE 'needs_verification' END AS status, toxic, quality FROM labels)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("image"), F.expr("p_partkey div 2").alias("unit"))


UNITS = "units AS (SELECT p_size AS image, p_partkey // 2 AS unit FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as recorders write them, from event times."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss")
    kind = F.element_at(F.array(*map(F.lit, ("driving", "event", "parking", "clip"))), (F.col("event_id") % 4 + 1).cast("int"))
    side = F.element_at(F.array(*map(F.lit, ("_F", "_R", "_rear", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/cam"), (F.col("user_id") % 50).cast("string"), F.lit("/"), kind, F.lit("/"), stamp, side, F.lit(".mp4"))
    return e.select(F.col("event_id").alias("id"), path.alias("path"))


NAMES = """names AS (SELECT event_id AS id, '/cam' || (user_id % 50)::VARCHAR || '/' || ['driving', 'event', 'parking', 'clip'][(event_id % 4 + 1)::INTEGER] || '/'
  || strftime(ts, '%Y%m%d_%H%M%S') || ['_F', '_R', '_rear', ''][(event_id % 4 + 1)::INTEGER] || '.mp4' AS path FROM events)"""


def package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest, and the files found: some missing, some changed, some not listed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("media/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes"))
    manifest = d.filter("doc_id % 31 <> 0").unionByName(d.filter("doc_id % 37 = 0 and doc_id % 31 <> 0"))
    files = d.filter("doc_id % 19 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 23 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return manifest.drop("doc_id"), files.drop("doc_id")


PACKAGE = """d AS (SELECT doc_id, 'media/' || doc_id::VARCHAR || '.mp4' AS path, sha256(text) AS sha256, n_chars AS size_bytes FROM documents),
manifest AS (SELECT * FROM d WHERE doc_id % 31 <> 0 UNION ALL SELECT * FROM d WHERE doc_id % 37 = 0 AND doc_id % 31 <> 0),
files AS (SELECT path, CASE WHEN doc_id % 23 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256, size_bytes FROM d WHERE doc_id % 19 <> 0)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job events: job, seq, status, units."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 == 0, "done").when(F.col("event_id") % 7 == 0, "failed").otherwise("running")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), status.alias("status"), F.floor("value").cast("long").alias("units"))


JOBS = "jobs AS (SELECT user_id AS job, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'done' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'running' END AS status, floor(value)::BIGINT AS units FROM events)"


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as log entries: lane, line_no, body (JSON), usable, ts, run_id, is_marker, is_repair, event, id."""
    c = table(spark, sf_dir, "conversations")
    line = F.col("turn") + 1
    event = F.when(F.col("turn") % 3 == 0, "begin").when(F.col("turn") % 3 == 1, "complete").otherwise("resolve")
    key = (F.col("conv_id") * 7 + F.floor(F.col("turn") / 2)) % 11
    body = F.to_json(F.struct(F.lit("record").alias("event"), F.concat(F.lit("vid_"), key.cast("string")).alias("id"), F.col("role").alias("role")))
    return c.select(
        F.col("conv_id").alias("lane"), line.alias("line_no"), body.alias("body"), (F.length("text") % 5 != 0).alias("usable"),
        (1_700_000_000 + F.col("conv_id") * 1000 + line).alias("ts"), F.concat(F.lit("run"), F.floor(F.col("turn") / 2).cast("string")).alias("run_id"),
        (F.col("turn") % 2 == 1).alias("is_marker"), (F.length("text") % 13 == 0).alias("is_repair"), event.alias("event"), F.concat(F.lit("vid_"), key.cast("string")).alias("id"),
    )


ENTRIES = """entries AS (SELECT conv_id AS lane, turn + 1 AS line_no, length(text) % 5 <> 0 AS usable, 1700000000 + conv_id * 1000 + turn + 1 AS ts, 'run' || (turn // 2)::VARCHAR AS run_id,
  turn % 2 = 1 AS is_marker, length(text) % 13 = 0 AS is_repair, CASE turn % 3 WHEN 0 THEN 'begin' WHEN 1 THEN 'complete' ELSE 'resolve' END AS event,
  'vid_' || ((conv_id * 7 + turn // 2) % 11)::VARCHAR AS id FROM conversations)"""


#: Hex keys that sign the lanes: k1 is held by the queries' reader, k9 is not; k0 is an older one, retired.
LANE_KEYS = {"k0": "22" * 32, "k1": "11" * 32, "k9": "99" * 32}


def lane_lines(spark: SparkSession, sf_dir: str, keyed: bool = False, damage: bool = True, tails: bool = False, rotation: bool = False) -> DataFrame:
    """Conversation turns as chained log lines (lane, line_no, raw). The hash of a line needs the one before, so a task goes along its lanes row by row and holds one hash.

    With `damage` one lane in five has a changed byte in its second line. With `keyed`, lanes
    by conv_id modulo 6: 0 unkeyed; from the second line on 1 signed under k1 and 2 under k9,
    both with an introduction, 3 under k1 without one; 4 first line under k1, the others under
    k9; 5 from the second line on under the name k1, but by another key. With `tails`, lanes by
    conv_id modulo 8: 1 and 2 hold line separators of Unicode in each line; behind the last
    line 3 has a carriage return, 4 a blank, 5 a letter. With `rotation`, lanes by conv_id
    modulo 4: 0 and 1 two lines under k0, then one under k1 that retires k0, then 0 under k1, 1
    under k0 again; 2 the second line under k1, all others under k0; 3 all under k0.
    """

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, head, number = None, GENESIS, 0
        for batch in batches:
            out = []
            for conv, turn, role in zip(batch["conv_id"].tolist(), batch["turn"].tolist(), batch["role"].tolist(), strict=True):
                if conv != lane:
                    lane, head, number = conv, GENESIS, 0
                first, kind = number == 0, conv % 6 if keyed else 0
                odd = {1: "\u2028", 2: "\x85"}.get(conv % 8, "") if tails else ""
                intro = ',"kind":"audit-key-introduced"' if number == 1 and kind in (1, 2) else ""
                turned = rotation and number == 2 and conv % 4 in (0, 1)
                intro = ',"kind":"audit-key-rotate","from":"k0"' if turned else intro
                body = f'{{"turn":{turn},"role":"{role}{odd}"{intro},"previous_entry_sha256":"{head}"'
                signed = body + "}"
                key, name = (None, None) if first and kind != 4 else {1: ("k1", "k1"), 2: ("k9", "k9"), 3: ("k1", "k1"), 4: ("k1", "k1") if first else ("k9", "k9"), 5: ("k9", "k1")}.get(kind, (None, None))
                if rotation:
                    key = name = "k1" if turned or (conv % 4 == 0 and number > 2) or (conv % 4 == 2 and number == 1) else "k0"
                tag = "" if key is None else f',"entry_hmac_sha256":"{hmac.new(bytes.fromhex(LANE_KEYS[key]), signed.encode(), hashlib.sha256).hexdigest()}","entry_hmac_key_id":"{name}"'
                raw = f'{body},"entry_sha256":"{hashlib.sha256(signed.encode()).hexdigest()}"{tag}}}'
                head, number = hashlib.sha256(raw.encode()).hexdigest(), number + 1
                out.append((conv, number, raw))
            yield pd.DataFrame(out, columns=["lane", "line_no", "raw"])

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role")
    lines = turns.mapInPandas(chained, "lane long, line_no long, raw string")
    if damage:
        lines = lines.withColumn("raw", F.when((F.col("lane") % 5 == 0) & (F.col("line_no") == 2), F.regexp_replace("raw", '"turn":', '"turm":')).otherwise(F.col("raw")))
    if tails:
        sizes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_lane")).agg(F.count("*").alias("_n"))
        tail = F.element_at(F.create_map(*map(F.lit, (3, "\r", 4, " ", 5, "x"))), (F.col("lane") % 8).cast("int"))
        lines = lines.join(sizes, F.col("lane") == F.col("_lane")).withColumn("raw", F.when(F.col("line_no") == F.col("_n"), F.concat("raw", F.coalesce(tail, F.lit("")))).otherwise(F.col("raw"))).drop("_lane", "_n")
    return lines
