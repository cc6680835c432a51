"""Queries over sequences and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..operators import sequence as S
from ..session import written
from . import views as V
from .registry import query


@query("w1_timestamp_findings", f"""WITH {V.CATALOG}, d AS (SELECT parent_dir, id, modified_unix - lag(modified_unix) OVER (PARTITION BY parent_dir ORDER BY source_path, id) AS delta FROM catalog WHERE modified_unix > 0)
SELECT parent_dir, id, CASE WHEN delta < 0 THEN 'regression' ELSE 'gap' END AS kind, delta FROM d WHERE delta < 0 OR delta > 604800""")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.timestamp_findings(V.catalog(spark, sf_dir))


@query("w2_frame_gap_findings", f"""WITH {V.FRAMES}, d AS (SELECT *, seconds - lag(seconds) OVER (PARTITION BY file, channel ORDER BY "offset") AS delta FROM frames)
SELECT file, channel, "offset", CASE WHEN seconds IS NULL THEN 'invalid-date' WHEN delta < 0 THEN 'regression' ELSE 'gap' END AS kind, delta FROM d WHERE seconds IS NULL OR delta < 0 OR delta > 2""")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_gap_findings(V.frames(spark, sf_dir))


JUNCTIONS = f"""{V.SEGMENTS}, s AS (SELECT *, lead(id) OVER w AS next_id, lead(start_s) OVER w AS next_start FROM segments WINDOW w AS (PARTITION BY camera ORDER BY start_s, id)),
j AS (SELECT camera, id, next_id, round(next_start - (start_s + duration_s), 3) AS delta_s FROM s),
junctions AS (SELECT *, CASE WHEN next_id IS NULL THEN 'last' WHEN delta_s IS NULL THEN 'unknown' WHEN abs(delta_s) <= 60 + 1e-9 THEN 'continuous' WHEN delta_s > 0 THEN 'gap' ELSE 'overlap' END AS state FROM j)"""


@query("w3_junctions", f"WITH {JUNCTIONS} SELECT * FROM junctions")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.junctions(V.segments(spark, sf_dir))


@query("w4_running_offset", f"WITH {V.SEGMENTS} SELECT camera, id, round(coalesce(sum(duration_s) OVER (PARTITION BY camera ORDER BY start_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS offset_s FROM segments")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_offset(V.segments(spark, sf_dir))


@query("a11_junction_totals", f"""WITH {JUNCTIONS} SELECT camera, count(*) AS segments, count(*) FILTER (state = 'gap') AS gaps, round(coalesce(sum(abs(delta_s)) FILTER (state = 'gap'), 0), 3) AS gap_s, max(abs(delta_s)) FILTER (state = 'gap') AS max_gap_s,
  count(*) FILTER (state = 'overlap') AS overlaps, round(coalesce(sum(abs(delta_s)) FILTER (state = 'overlap'), 0), 3) AS overlap_s, count(*) FILTER (state = 'continuous') AS continuous, count(*) FILTER (state = 'unknown') AS unknown,
  (SELECT round(sum(duration_s), 3) FROM segments s WHERE s.camera = junctions.camera) AS duration_s FROM junctions GROUP BY camera""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir)
    return S.junction_totals(S.junctions(s), s)


@query("a13_segment_compat", f"""WITH {V.CATALOG}, g AS (SELECT source AS grp, count(*) AS n, count(DISTINCT extension) AS codecs, count(sha256) - count(DISTINCT sha256) AS dup, count(*) FILTER (modified_unix IS NULL) AS nodur, count(modified_unix) - count(DISTINCT modified_unix) AS same,
  count(DISTINCT parent_dir) AS folders, count(DISTINCT lang) AS channels, count(*) FILTER (doc_id % 2 = 0) AS audio FROM catalog GROUP BY source)
SELECT * FROM (SELECT grp AS "group", 'blocking' AS severity, 'duplicate-hash' AS code, dup AS n FROM g UNION ALL SELECT grp, 'blocking', 'codec-differs', CASE WHEN codecs > 1 THEN codecs ELSE 0 END FROM g
UNION ALL SELECT grp, 'warning', 'unknown-duration', nodur FROM g UNION ALL SELECT grp, 'warning', 'same-start', same FROM g UNION ALL SELECT grp, 'warning', 'folder-differs', CASE WHEN folders > 1 THEN folders ELSE 0 END FROM g
UNION ALL SELECT grp, 'warning', 'mixed-channel', CASE WHEN channels > 1 THEN channels ELSE 0 END FROM g UNION ALL SELECT grp, 'warning', 'audio-in-some', CASE WHEN audio BETWEEN 1 AND n - 1 THEN audio ELSE 0 END FROM g) WHERE n > 0""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    c = c.select(F.col("source").alias("group"), "id", "source_path", "sha256", F.col("extension").alias("codec"), F.col("modified_unix").alias("start_s"), F.col("modified_unix").alias("duration_s"), F.col("lang").alias("channel"), F.lit("v").alias("vendor"), "parent_dir", (F.col("doc_id") % 2 == 0).alias("has_audio"))
    return S.segment_compat(c, fields=("codec",))


@query("w9_unit_runs", f"""WITH {V.UNITS}, d AS (SELECT DISTINCT image, unit FROM units), r AS (SELECT *, unit - row_number() OVER (PARTITION BY image ORDER BY unit) AS i FROM d)
SELECT image, min(unit) AS first, count(*) AS count FROM r GROUP BY image, i""")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unit_runs(V.units(spark, sf_dir))


@query("a15_skipped_units", f"""WITH {V.UNITS}, d AS (SELECT DISTINCT image, unit FROM units), r AS (SELECT image, unit - lag(unit) OVER (PARTITION BY image ORDER BY unit) - 1 AS h FROM d)
SELECT image, coalesce(sum(greatest(h, 0)), 0)::BIGINT AS skipped FROM r GROUP BY image""")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.skipped_units(V.units(spark, sf_dir))


def _frame_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = V.table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return l.select((F.col("l_suppkey") % 5).alias("image"), start.alias("start_b"), (start + 1 + F.col("l_quantity").cast("long") % 3).alias("end_b"), (F.col("l_returnflag") == "N").alias("is_video")).distinct()


@query("w10_frame_runs", """WITH u AS (SELECT DISTINCT l_suppkey % 5 AS image, l_orderkey * 8 + l_linenumber AS start_b, l_orderkey * 8 + l_linenumber + 1 + l_quantity::BIGINT % 3 AS end_b, l_returnflag = 'N' AS is_video FROM lineitem),
s AS (SELECT *, CASE WHEN start_b - lag(end_b) OVER w BETWEEN 0 AND 8 THEN 0 ELSE 1 END AS n FROM u WINDOW w AS (PARTITION BY image ORDER BY start_b, end_b, is_video)),
i AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY start_b, end_b, is_video ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT image, min(start_b) AS start_b, max(end_b) AS end_b, count(*) AS frames, count(*) FILTER (is_video) AS video FROM i GROUP BY image, k HAVING count(*) FILTER (is_video) >= 3""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_runs(_frame_units(spark, sf_dir), least_video=3, slack=8)


@query("w11_mark_duplicates", f"""WITH {V.CATALOG}, f AS (SELECT *, first(id) OVER (PARTITION BY sha256 ORDER BY doc_id, id) AS f FROM catalog)
SELECT id, CASE WHEN sha256 IS NOT NULL AND f <> id THEN f END AS duplicate_of FROM f""")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mark_duplicates(V.catalog(spark, sf_dir), ["doc_id"]).select("id", "duplicate_of")


@query("w17_compress_runs", """WITH e AS (SELECT user_id AS lane, event_id AS seq, event_type AS kind, value < 50 AS un FROM events),
s AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND un AND lag(un) OVER w THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY lane ORDER BY seq)),
i AS (SELECT *, sum(n) OVER (PARTITION BY lane ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT lane, 'audit' AS source, min(kind) AS kind, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM i GROUP BY lane, k""")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("seq"), F.lit("audit").alias("source"), F.col("event_type").alias("kind"), (F.col("value") < 50).alias("unaudited"))
    return S.compress_runs(e)


@query("w18_assign_ids", f"""WITH {V.CASES}, t AS (SELECT max(substr(id, 5)::BIGINT) AS top FROM case_a), f AS (SELECT source_path, row_number() OVER (ORDER BY source_path) AS n FROM case_b WHERE source_path NOT IN (SELECT source_path FROM case_a))
SELECT b.source_path AS path_key, a.id FROM case_b b JOIN case_a a ON b.source_path = a.source_path UNION ALL SELECT source_path, printf('vid_%06d', top + n) FROM f, t""")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    return S.assign_ids(b.select(F.col("source_path").alias("path_key")), a.select(F.col("source_path").alias("path_key"), "id"))


@query("j19_fragment_chain", """WITH p AS (SELECT user_id % 20 AS image, event_id // 10 AS fragment, event_id AS "offset", event_id % 2 AS pid, (floor(value)::BIGINT % 2 + event_id // 10) % 16 AS counter, event_id % 3 > 0 AS payload FROM events),
e AS (SELECT image, fragment, pid, min_by(counter, "offset") AS hc, min_by(payload, "offset") AS hp, max_by(counter, "offset") AS tc FROM p GROUP BY ALL),
f AS (SELECT image, fragment, min("offset") AS start_b, lag(fragment) OVER (PARTITION BY image ORDER BY fragment) AS prev FROM p GROUP BY image, fragment),
l AS (SELECT f.image, f.fragment, bool_and(h.hc = (t.tc + CASE WHEN h.hp THEN 1 ELSE 0 END) % 16) AS ok FROM f JOIN e h ON f.image = h.image AND f.fragment = h.fragment JOIN e t ON t.image = f.image AND t.fragment = f.prev AND t.pid = h.pid GROUP BY ALL),
i AS (SELECT f.*, sum(CASE WHEN coalesce(ok, false) THEN 0 ELSE 1 END) OVER (PARTITION BY f.image ORDER BY f.fragment ROWS UNBOUNDED PRECEDING) AS k FROM f LEFT JOIN l ON f.image = l.image AND f.fragment = l.fragment)
SELECT image, k::BIGINT AS chain, min(fragment) AS first_fragment, count(*) AS fragments, min(start_b) AS start_b FROM i GROUP BY image, k HAVING count(*) >= 2""")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    frag = F.expr("event_id div 10")
    p = e.select((F.col("user_id") % 20).alias("image"), frag.alias("fragment"), F.col("event_id").alias("offset"), (F.col("event_id") % 2).alias("pid"), ((F.floor("value") % 2 + frag) % 16).alias("counter"), (F.col("event_id") % 3 > 0).alias("payload"))
    return S.fragment_chain(p)


@query("j24_verify_concat", f"""WITH {V.SEGMENTS}, n AS (SELECT camera, count(*) AS n, max(CASE WHEN id % 200 = 0 THEN 1 ELSE 0 END) AS bad FROM segments GROUP BY camera)
SELECT camera AS "group", true AS packets_ok, bad = 0 AS hashes_ok, true AS starts_ok, CASE WHEN bad = 0 THEN 'verified' ELSE 'failed' END AS verdict FROM n""")
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir)
    src = s.select(F.col("camera").alias("group"), F.struct("start_s", "id").alias("segment"), F.col("id").alias("seq"), F.lit(0.0).alias("pts"), F.lit(True).alias("is_key"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), "duration_s")
    o = S.running_offset(s).join(s.select("camera", "id", "start_s"), ["camera", "id"])
    out = o.select(F.col("camera").alias("group"), F.struct("start_s", "id").alias("seq"), F.col("offset_s").alias("pts"), F.sha2(F.when(F.col("id") % 200 == 0, "x").otherwise(F.col("id").cast("string")), 256).alias("hash"))
    return S.verify_concat(src, out).drop("mode", "audio_ok")


#: What each kind of join (image modulo 7) is found to be; kinds are told in j24_kept_mode.
KEPT = "CASE WHEN \"group\" % 7 IN (1, 3, 5) THEN 'edit-list-applied' ELSE 'all-packets' END AS mode, \"group\" % 11 <> 0 AS audio_ok, CASE WHEN \"group\" % 7 IN (0, 1, 3, 5) AND \"group\" % 11 <> 0 THEN 'verified' ELSE 'failed' END AS verdict"


@query("j24_kept_mode", f"""SELECT "group", {KEPT} FROM (SELECT DISTINCT l_suppkey AS "group" FROM lineitem)""")
def j24b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of seven segments, some packets hidden. Modulo 7: 0 shows all packets; 1 the kept ones; 2 these in another order; 3 the kept ones, all key frames; 4 lacks a segment; 5 rewrites key frames, 6 others. Modulo 11: 0 lacks sound."""
    l, kind = V.table(spark, sf_dir, "lineitem"), F.col("group") % 7
    p = l.select(
        F.col("l_suppkey").alias("group"), F.col("l_linenumber").alias("segment"), "l_orderkey", "l_partkey", (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("seq"), (F.col("l_quantity") < 8).alias("discard"),
        ((F.col("l_suppkey") % 7 == 3) | (F.col("l_orderkey") % 8 == 0)).alias("is_key"),
    )
    digest = F.sha2(F.concat_ws(":", "l_orderkey", "l_partkey", "segment"), 256)
    s = p.withColumns({"pts": F.lit(0.0), "duration_s": F.lit(30.0), "hash": digest})
    o = p.filter((kind == 0) | ~F.col("discard")).filter((kind != 4) | (F.col("segment") != 3)).withColumn("seq", F.when(kind == 2, -F.col("seq")).otherwise(F.col("seq")))
    changed = ((kind == 5) & F.col("is_key")) | ((kind == 6) & ~F.col("is_key"))
    n = F.row_number().over(Window.partitionBy("group", "segment").orderBy("seq"))
    # The hash is told behind the window, so that only its parts are dealt.
    o = o.withColumn("n", n).select("group", F.struct("segment", "seq").alias("seq"), ((F.col("segment") - 1) * 30 + F.col("n") * 0.001).alias("pts"), F.when(changed, F.sha2(digest, 256)).otherwise(digest).alias("hash"), "is_key")
    sound = s.select("group", "segment").distinct().withColumn("packets", F.lit(100).cast("long"))
    heard = sound.groupBy("group").agg((F.sum("packets") + F.when(F.col("group") % 11 == 0, -8).otherwise(7)).cast("long").alias("packets"))
    return S.verify_concat(s, o, sound, heard).select("group", "mode", "audio_ok", "verdict")


@query("w5_hit_extents", """WITH h AS (SELECT l_suppkey AS image, l_partkey * 5000 + l_orderkey % 4096 AS "offset", min(l_returnflag) AS signature, max(CASE WHEN l_quantity > 30 THEN l_quantity::BIGINT * 200 END) AS declared FROM lineitem GROUP BY ALL),
z AS (SELECT image, max("offset") + 9000 AS size FROM h GROUP BY image),
r AS (SELECT h.*, size, least(coalesce(lead("offset") OVER (PARTITION BY h.image ORDER BY "offset"), size), size, "offset" + 1073741824) - "offset" AS room FROM h JOIN z ON h.image = z.image)
SELECT image, "offset", signature, CASE WHEN declared <= size - "offset" THEN declared ELSE room END AS length, CASE WHEN declared <= size - "offset" THEN 'declared' ELSE 'next-boundary' END AS basis FROM r
WHERE CASE WHEN declared <= size - "offset" THEN declared ELSE room END >= 1024""")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = V.table(spark, sf_dir, "lineitem")
    h = l.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") * 5000 + F.col("l_orderkey") % 4096).alias("offset")).agg(F.min("l_returnflag").alias("signature"), F.max(F.when(F.col("l_quantity") > 30, F.col("l_quantity").cast("long") * 200)).alias("declared"))
    return I.hit_extents(h, h.groupBy("image").agg((F.max("offset") + 9000).alias("size")))


@query("w6_free_regions", f"""WITH {V.CLAIMED}, d AS (SELECT image, start_b, max(end_b) OVER (PARTITION BY image ORDER BY start_b, end_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM claimed)
SELECT image, o AS start_b, start_b AS end_b FROM d WHERE start_b - o >= 512""")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.free_regions(V.claimed(spark, sf_dir))


SPANS = "spans AS (SELECT p_partkey % 10 + 1 AS image, p_partkey AS span, p_partkey * 4096 AS start_b, p_partkey * 4096 + 20000 AS end_b FROM part)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return V.table(spark, sf_dir, "part").select((p % 10 + 1).alias("image"), p.alias("span"), (p * 4096).alias("start_b"), (p * 4096 + 20000).alias("end_b"))


@query("w6_uncovered", f"""WITH {V.CLAIMED}, {SPANS}, x AS (SELECT s.image, s.span, greatest(s.start_b, c.start_b) AS a, least(s.end_b, c.end_b) AS b FROM spans s JOIN claimed c ON s.image = c.image AND c.start_b < s.end_b AND s.start_b < c.end_b AND c.end_b > c.start_b
UNION ALL SELECT image, span, start_b, start_b FROM spans UNION ALL SELECT image, span, end_b, end_b FROM spans),
d AS (SELECT *, max(b) OVER (PARTITION BY image, span ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM x)
SELECT image, span, o AS start_b, a AS end_b FROM d WHERE a > o""")
def w6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.uncovered(_spans(spark, sf_dir), V.claimed(spark, sf_dir))


@query("j15_point_in_runs", f"""WITH {V.UNITS}, q AS (SELECT DISTINCT l_suppkey % 50 + 1 AS image, l_partkey % 1200 AS unit FROM lineitem)
SELECT image, unit, EXISTS (SELECT 1 FROM units u WHERE u.image = q.image AND u.unit = q.unit) AS inside FROM q""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50 + 1).alias("image"), (F.col("l_partkey") % 1200).alias("unit")).distinct()
    return I.point_in_runs(q, S.unit_runs(V.units(spark, sf_dir)), size=64)


@query("j16_stream_to_physical", f"""WITH {V.UNITS}, r AS (SELECT DISTINCT image, unit AS seq, unit * 10000 + 7 AS phys_b, (unit % 5 + 1) * 1000 AS length_b FROM units),
o AS (SELECT *, coalesce(sum(length_b) OVER (PARTITION BY image ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM r),
g AS (SELECT p_size AS image, p_partkey AS range_id, p_partkey % 97 * 250 AS a, p_partkey % 97 * 250 + 2600 AS b FROM part)
SELECT g.image, range_id, phys_b + greatest(a, s) - s AS phys_start, phys_b + least(b, s + length_b) - s AS phys_end, (row_number() OVER (PARTITION BY g.image, range_id ORDER BY seq) - 1)::INTEGER AS part
FROM g JOIN o ON g.image = o.image AND a < s + length_b AND s < b""")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = V.units(spark, sf_dir).distinct()
    runs = u.select("image", F.col("unit").alias("seq"), (F.col("unit") * 10000 + 7).alias("phys_b"), ((F.col("unit") % 5 + 1) * 1000).alias("length_b"))
    p = F.col("p_partkey")
    ranges = V.table(spark, sf_dir, "part").select(F.col("p_size").alias("image"), p.alias("range_id"), (p % 97 * 250).alias("start_b"), (p % 97 * 250 + 2600).alias("end_b"))
    return I.stream_to_physical(ranges, runs, size=4096)


@query("j17_owner_asof", f"""WITH {V.CLAIMED}, o AS (SELECT image, start_b, max(end_b) AS owner FROM claimed WHERE start_b % 3 = 0 GROUP BY ALL), q AS (SELECT DISTINCT image, end_b AS "offset" FROM claimed)
SELECT q.image, q."offset", o.owner FROM q ASOF LEFT JOIN o ON q.image = o.image AND q."offset" >= o.start_b""")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.claimed(spark, sf_dir)
    owners = c.filter("start_b % 3 = 0").groupBy("image", "start_b").agg(F.max("end_b").alias("owner"))
    return I.owner_asof(c.select("image", F.col("end_b").alias("offset")).distinct(), owners)


@query("j18_exclude_covered", f"""WITH {V.CLAIMED}, {SPANS} SELECT image, start_b, end_b FROM claimed c WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.image = c.image AND c.start_b >= s.start_b AND c.start_b < s.end_b)""")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.exclude_covered(V.claimed(spark, sf_dir), _spans(spark, sf_dir), size=1 << 16).select("image", "start_b", "end_b")


FRAME_RUNS = """runs AS (SELECT DISTINCT image, CASE WHEN span % 3 = 0 THEN 'avi-frames' WHEN span % 3 = 1 THEN 'h264-frames' ELSE 'dhav-frames' END AS kind, start_b * 3 + 1000 AS start_b, start_b * 3 + CASE WHEN span % 3 = 0 THEN 90000 ELSE 9000 END AS end_b FROM spans),
hits AS (SELECT image, start_b AS "offset", min(CASE WHEN start_b % 5 = 0 THEN 'jpeg' WHEN start_b % 5 = 1 THEN 'riff-avi' WHEN start_b % 5 = 2 THEN 'h264-annexb' ELSE 'h265-annexb' END) AS signature, max(CASE WHEN end_b % 7 = 0 THEN start_b - 64 END) AS nested_in, max(end_b) AS until FROM claimed GROUP BY ALL),
alone AS (SELECT * FROM hits h WHERE signature <> 'jpeg' AND nested_in IS NULL AND NOT (signature LIKE '%annexb' AND EXISTS (SELECT 1 FROM runs r WHERE r.image = h.image AND h."offset" >= r.start_b AND h."offset" < r.end_b))),
kept AS (SELECT * FROM runs n WHERE NOT (kind = 'h264-frames' AND EXISTS (SELECT 1 FROM runs a WHERE a.kind = 'avi-frames' AND a.image = n.image AND n.start_b < a.end_b AND a.start_b < n.end_b))
AND NOT EXISTS (SELECT 1 FROM alone h WHERE h.image = n.image AND n.start_b >= h."offset" AND n.start_b < h.until))"""


@query("j18_frame_candidates", f"""WITH {V.CLAIMED}, {SPANS}, {FRAME_RUNS} SELECT image, signature AS kind, "offset" AS start_b FROM alone UNION ALL SELECT image, kind, start_b FROM kept""")
def j18_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("span") % 3
    runs = _spans(spark, sf_dir).select("image", F.when(n == 0, "avi-frames").when(n == 1, "h264-frames").otherwise("dhav-frames").alias("kind"), (F.col("start_b") * 3 + 1000).alias("start_b"), (F.col("start_b") * 3 + F.when(n == 0, 90000).otherwise(9000)).alias("end_b")).distinct()
    at = F.col("start_b") % 5
    name = F.when(at == 0, "jpeg").when(at == 1, "riff-avi").when(at == 2, "h264-annexb").otherwise("h265-annexb")
    hits = V.claimed(spark, sf_dir).groupBy("image", F.col("start_b").alias("offset")).agg(F.min(name).alias("signature"), F.max(F.when(F.col("end_b") % 7 == 0, F.col("start_b") - 64)).alias("nested_in"), F.max("end_b").alias("until"))
    lone = written(I.lone_hits(hits, runs, 1 << 16))
    kept = I.lone_runs(runs, lone.select("image", F.col("offset").alias("start_b"), F.col("until").alias("end_b")), 1 << 16)
    return lone.select("image", F.col("signature").alias("kind"), F.col("offset").alias("start_b")).unionByName(kept.select("image", "kind", "start_b"))
