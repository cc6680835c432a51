"""Queries of byte scans, over chunks that Spark makes from the documents' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bytescan as B
from ..session import scratch
from ..sources import readers
from . import views as V
from .registry import query


def _chunks(spark: SparkSession, sf_dir: str, planted: Column) -> DataFrame:
    """One chunk per document: some filler, the planted bytes, the text."""
    filler = F.encode(F.repeat(F.lit("."), (F.col("doc_id") % 50).cast("int")), "UTF-8")
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("image"), F.lit(0).cast("long").alias("start_b"), F.concat(filler, planted, F.encode("text", "UTF-8")).alias("bytes"))


#: What b1 plants behind the filler: bytes in hexadecimal (None: a RIFF size), and the signature that begins with them.
PLANTED = (
    ("00000018667479706D703432", "mp4-ftyp"), ("FFD8FF00", "jpeg"), ("52494646", "riff-avi"), (None, None), ("41564920", None), ("5249464601020304", "riff-avi"), ("41564958", None),
    ("000001BA21", "mpeg-ps"), ("000001BA44", "mpeg-ps"), ("000001BA2F", None), ("000001BA40", None), ("0000000167", "h264-annexb"), ("0000000142", "h265-annexb"), ("0000000140", "h265-annexb"), ("0000000127", None),
    ("00000142", None), ("44484156", "dahua-dhav"), ("494D4B48", "hikvision-imkh"), ("1A45DFA3", "ebml-mkv"),
)


def _planted_sql() -> str:
    at, rows, sized = 0, [], None
    for text, name in PLANTED:
        if text is None:
            sized = at - 4
        if name:
            rows.append((at, name))
        at += len(text or "00000000") // 2
    values = ", ".join(f"({at}, '{name}', {'true' if at == sized else 'false'})" for at, name in rows)
    return f"""SELECT doc_id::VARCHAR AS image, doc_id % 50 + o AS "offset", s AS signature, CASE WHEN sized AND doc_id % 256 >= 12 THEN doc_id % 256 + 8 END AS declared, CASE WHEN sized AND doc_id % 256 > 8 THEN doc_id % 256 END AS claim FROM documents, (VALUES {values}) v(o, s, sized)"""


@query("b1_scan_signatures", _planted_sql())
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lpad(F.hex(F.col("doc_id") % 256), 2, "0"), F.lit("000000"))
    return B.scan_signatures(_chunks(spark, sf_dir, F.unhex(F.concat(*[size if text is None else F.lit(text) for text, _ in PLANTED]))))


@query("b2_ts_runs", """SELECT doc_id::VARCHAR AS image, doc_id % 50 * 80 AS start_b, doc_id % 50 * 80 + doc_id % 7 * 188 AS end_b, doc_id % 7 AS packets FROM documents WHERE doc_id % 7 >= 4""")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets behind up to 4,000 bytes of filler, in overlapping chunks, so that many runs lie across a border."""
    n, chunk, overlap = F.col("doc_id"), 2048, 752
    packet = F.concat(F.lit("47"), F.repeat(F.lit("00"), 187))
    whole = F.concat(F.unhex(F.repeat(F.lit("2E"), (n % 50 * 80).cast("int"))), F.unhex(F.repeat(packet, (n % 7).cast("int"))), F.encode(F.lower("text"), "UTF-8"))
    d = V.table(spark, sf_dir, "documents").select(n.cast("string").alias("image"), whole.alias("whole"))
    d = d.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("whole"), F.lit(chunk))))
    start = F.greatest(F.col("at") - overlap, F.lit(0))
    return B.ts_runs(d.select("image", start.cast("long").alias("start_b"), F.substring("whole", start + 1, F.col("at") + chunk - start).alias("bytes")))


@query("b3_track_points", """SELECT doc_id::VARCHAR AS image, doc_id % 50 AS "offset", CASE WHEN doc_id % 3 = 0 THEN 8 + 7.038::DOUBLE / 60 ELSE 48 + 7.038::DOUBLE / 60 END * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS lat, 11 + 31.0::DOUBLE / 60 AS lon,
  CASE WHEN doc_id % 4 = 0 THEN '1994-03-23' ELSE '2024-03-23' END AS day, (doc_id % 24) * 3600 + 35 * 60 + 19 AS time_s, 22.4::DOUBLE * 1.852 AS speed_kmh, NULL::DOUBLE AS alt_m FROM documents WHERE doc_id % 5 > 0""")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences before a line's end or binary bytes, with short degrees, blank hemispheres and years of two centuries."""
    n = F.col("doc_id")
    side = F.when(n % 4 == 2, "").when(n % 2 == 0, "N").otherwise("S")
    year = F.when(n % 4 == 0, "94").otherwise("24")
    text = F.concat(F.lit("$GPRMC,"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit("3519,"), F.when(n % 5 > 0, "A").otherwise("V"), F.lit(","), F.when(n % 3 == 0, "807.038").otherwise("4807.038"), F.lit(","), side, F.lit(",01131.000,E,022.4,084.4,2303"), year, F.lit(",003.1,W*6A"))
    end = F.when(n % 6 == 0, F.unhex(F.lit("0000FF"))).otherwise(F.unhex(F.lit("0D0A")))
    return B.track_points(_chunks(spark, sf_dir, F.concat(F.encode(text, "UTF-8"), end)))


@query("b4_frame_headers", """SELECT doc_id::VARCHAR AS image, doc_id % 50 AS "offset", CASE WHEN doc_id % 3 = 0 THEN 240 ELSE 253 END AS type, (doc_id % 4)::INTEGER AS channel, 5::BIGINT AS packed_date, (doc_id % 256)::INTEGER AS counter, 256::BIGINT AS length, doc_id % 3 > 0 AS is_video FROM documents""")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    head = F.concat(F.lit("44484156"), F.when(n % 3 == 0, "F0").otherwise("FD"), F.lit("00"), byte(n % 4), F.lit("00"), F.lit("07000000"), F.lit("00010000"), F.lit("05000000"), byte(n % 256), F.lit("00"), F.lit("0000"))
    return B.frame_headers(_chunks(spark, sf_dir, F.unhex(head)))


@query("w10_frame_chains", """WITH d AS (SELECT doc_id::VARCHAR AS image, doc_id % 50 AS o, 20 + doc_id % 25 AS k, 8 + doc_id % 9 + 1 + (doc_id % 9 + 1) % 2 + 12 AS pair FROM documents)
SELECT image, 'avi-frames' AS kind, o AS start_b, o + k * pair + 10 + 3 * pair AS end_b, 2 * k + 7 AS units, k + 3 AS video FROM d WHERE k + 3 >= 30""")
def w10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video and audio chunks of 1 to 9 bytes in turn, a padding chunk, three more pairs; chunks of 512 bytes cut most runs."""
    n = F.col("doc_id")
    size = n % 9 + 1
    pair = F.concat(F.lit("30306463"), F.lpad(F.hex(size), 2, "0"), F.lit("000000"), F.repeat(F.lit("2E"), (size + size % 2).cast("int")), F.lit("3031776203000000"), F.lit("2E2E2E2E"))
    planted = F.unhex(F.concat(F.repeat(F.lit("2E"), (n % 50).cast("int")), F.repeat(pair, (n % 25 + 20).cast("int")), F.lit("4A554E4B020000000000"), F.repeat(pair, 3)))
    d = V.table(spark, sf_dir, "documents").select(n.cast("string").alias("image"), F.concat(planted, F.encode("text", "UTF-8")).alias("whole"))
    d = d.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("whole"), F.lit(512))))
    start = F.greatest(F.col("at") - 32, F.lit(0))
    chunks = d.select("image", start.cast("long").alias("start_b"), F.substring("whole", start + 1, F.col("at") + 512 - start).alias("bytes"))
    return B.frame_chains(B.frame_units(chunks))


NAMES = ("riff-avi", "jpeg", "mp4-ftyp", "mpegts-sync", "h264-annexb", "h265-annexb", "dahua-dhav", "riff-avi")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = V.table(spark, sf_dir, "lineitem")
    kind = (F.col("l_linenumber") + F.col("l_partkey")) % 8
    h = l.select(F.col("l_suppkey").cast("string").alias("image"), (F.col("l_partkey") * 100_000 + F.col("l_orderkey")).alias("offset"), F.element_at(F.array(*map(F.lit, NAMES)), (kind + 1).cast("int")).alias("signature"), F.when(kind == 0, F.col("l_quantity").cast("long") * 20_000).alias("claim"))
    return h.groupBy("image", "offset").agg(F.min("signature").alias("signature"), F.max("claim").alias("claim"))


HITS = f"""h AS (SELECT l_suppkey::VARCHAR AS image, l_partkey * 100000 + l_orderkey AS "offset", min({list(NAMES)}[((l_linenumber + l_partkey) % 8 + 1)::INTEGER]) AS signature, max(CASE WHEN (l_linenumber + l_partkey) % 8 = 0 THEN l_quantity::BIGINT * 20000 END) AS claim FROM lineitem GROUP BY 1, 2)"""
#: A walk along p (image, lo, hi): k has the kept rows, each the first at or behind the end of the one before.
WALK = """n AS MATERIALIZED (SELECT p.image, p.lo, p.hi, q.lo AS next FROM p ASOF LEFT JOIN p q ON p.image = q.image AND p.hi <= q.lo),
k AS (SELECT image, min(lo) AS lo FROM p GROUP BY image UNION ALL SELECT n.image, n.next FROM k JOIN n ON k.image = n.image AND k.lo = n.lo WHERE n.next IS NOT NULL)"""


@query("w7_suppress_nested", f"""WITH RECURSIVE {HITS}, p AS (SELECT image, "offset" AS lo, "offset" + 8 + least(claim, 1073741824) AS hi FROM h WHERE signature = 'riff-avi' AND claim IS NOT NULL), {WALK},
s AS (SELECT k.image, k.lo, p.hi FROM k JOIN p ON k.image = p.image AND k.lo = p.lo), m AS (SELECT *, "offset" + CASE WHEN signature = 'mp4-ftyp' THEN 4 ELSE 0 END AS met FROM h)
SELECT m.image, m."offset", signature, claim, CASE WHEN m.met > s.lo AND m.met < s.hi THEN s.lo END AS nested_in FROM m ASOF LEFT JOIN s ON m.image = s.image AND m.met > s.lo
WHERE NOT coalesce(m.met > s.lo AND m.met < s.hi, false) OR signature IN ('mp4-ftyp', 'riff-avi', 'dahua-dhav')""")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.suppress_nested(_hits(spark, sf_dir))


@query("w8_thin_anchors", f"""WITH RECURSIVE {HITS}, p AS (SELECT image, "offset" AS lo, "offset" + 4194304 AS hi FROM h WHERE signature LIKE 'h26%'), {WALK}
SELECT h.* FROM h WHERE signature NOT LIKE 'h26%' OR EXISTS (SELECT 1 FROM k WHERE k.image = h.image AND k.lo = h."offset")""")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.thin_anchors(_hits(spark, sf_dir))


@query("s5_read_manifest", f"WITH {V.CATALOG} SELECT source_path, CASE WHEN doc_id % 3 > 0 THEN sha256 END AS sha256 FROM catalog WHERE doc_id % 10 > 0")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(F.when(F.col("doc_id") % 10 == 0, "# ").otherwise(""), "source_path"), F.upper(F.when(F.col("doc_id") % 3 > 0, F.col("sha256")).otherwise("")))
    return readers.manifest_from_lines(c.select(line.alias("value")))


@query("s9_read_lanes", """SELECT 'lane=' || (conv_id % 20)::VARCHAR AS lane, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS line_no, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS raw FROM conversations""")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty log files, written by Spark, read in splits."""
    c = V.table(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role"))
    lanes = c.select((F.col("conv_id") % 20).alias("lane"), "conv_id", "turn", line.alias("value")).repartition("lane").sortWithinPartitions("lane", "conv_id", "turn")
    root = scratch(spark, "lanes")
    lanes.select("lane", "value").write.partitionBy("lane").option("lineSep", "\n").text(root)
    lines, _ = readers.read_lanes(spark, root, pattern="part-*")
    return lines.withColumn("lane", F.regexp_extract("lane", "^(lane=[^/]*)/", 1))
