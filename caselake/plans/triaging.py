"""Queries of columns, search, facets and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import profile as R
from ..functions import redact as D
from ..functions import times as M
from ..operators import lanes as N
from ..operators import linkage as L
from ..operators import maintain as U
from ..operators import triage as T
from ..sources import readers, sinks
from . import views as V
from .registry import query

RECORDS = f"""{V.CATALOG}, {V.MARKS}, records AS (SELECT c.*, coalesce(m.status, 'none') AS status, CASE extension WHEN 'mp4' THEN 'video' WHEN 'avi' THEN 'video' ELSE 'carved' END AS kind,
  strftime(make_timestamp((modified_unix * 1000000)::BIGINT), '%Y-%m-%d') AS day, c.parent_dir AS dir_path FROM catalog c LEFT JOIN marks m ON c.id = m.id)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir).join(V.marks(spark, sf_dir), "id", "left")
    return c.withColumns({"status": F.coalesce("status", F.lit("none")), "kind": F.when(F.col("extension").isin("mp4", "avi"), "video").otherwise("carved"), "day": M.day_of(F.col("modified_unix")), "dir_path": F.col("parent_dir"), "rec_ts": F.col("modified_unix"), "name": P.base_name(F.col("source_path"))})


@query("p1_path_keys", f"""WITH {V.NAMES} SELECT id, path AS path_key, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir_path, split_part(path, '/', 3) AS parent_dir FROM names""")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.names(spark, sf_dir)
    windows = F.concat(F.lit("\\\\?\\"), F.col("path"))
    return n.select("id", P.path_key(windows).alias("path_key"), P.dir_path(F.col("path")).alias("dir_path"), P.parent_dir(F.col("path")).alias("parent_dir"))


@query("p2_recording_time", f"""WITH n AS (SELECT event_id AS id, date_trunc('second', ts) AS t FROM events) SELECT id, epoch(t)::BIGINT AS secs_naive, strftime(t, '%Y-%m-%d %H:%M:%S') AS text, strftime(t, '%Y-%m-%d') AS "date", true AS has_time FROM n""")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.names(spark, sf_dir).select("id", M.recording_time(F.col("path")).alias("t")).select("id", "t.*")


@query("p3_creation_time", "SELECT event_id AS id, epoch(date_trunc('second', ts))::BIGINT - CASE event_id % 3 WHEN 2 THEN 19800 ELSE 0 END AS unix, event_id % 3 = 0 AS tz_assumed FROM events")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+05:30")), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), zone)
    e = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), M.creation_time(text).alias("t"))
    return e.select("id", "t.*")


@query("p4_channel_code", f"WITH {V.NAMES} SELECT id, CASE id % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'R' WHEN 2 THEN 'R' END AS channel FROM names")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.names(spark, sf_dir).select("id", P.channel_code(F.col("path")).alias("channel"))


@query("p5_pair_key", f"""WITH {V.NAMES} SELECT id, lower(regexp_replace(path, '/[^/]*$', '')) || '|' || regexp_extract(path, '(\\d{{8}}_\\d{{6}})', 1) AS pair_key FROM names""")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.names(spark, sf_dir).select("id", P.pair_key(F.col("path")).alias("pair_key"))


@query("p6_rec_type", f"WITH {V.NAMES} SELECT id, CASE id % 4 WHEN 0 THEN 'driving' WHEN 1 THEN 'event' WHEN 2 THEN 'parking' ELSE '' END AS rec_type, 'cam' AS prefix FROM names")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.names(spark, sf_dir).select("id", P.rec_type(F.col("path")).alias("rec_type"), P.prefix(F.col("path")).alias("prefix"))


#: What p8 plants by doc_id: folder and name before the number, extension, and the profile told for it.
PROFILED = (
    ("x\\HikVision\\a", "mp4", "hikvision", "Hikvision", "medium", "path contains vendor signal: hikvision"),
    ("ivms/a", "DAV", "dahua_dav", "Dahua / OEM DAV", "high", "proprietary extension: .dav"),
    ("vsplayer/ivms/a", "h264", "hikvision", "Hikvision", "medium", "path contains vendor signal: ivms"),
    ("DSS/a", "asf", "dahua_dav", "Dahua / OEM DAV", "medium", "ASF file under Dahua/SmartPSS/DSS-like path"),
    ("vapix/a", "mkv", "axis_onvif", "Axis", "medium", "MKV file under Axis/VAPIX-like path"),
    ("ACC/a", "avi", "avigilon_ave", "Avigilon ACC", "medium", "path contains vendor signal: /acc/"),
    ("c/아이나비/a", "mov", "thinkware_inavi", "Thinkware / iNavi", "medium", "path contains vendor signal: 아이나비"),
    ("a", "glv", "garmin_dashcam", "Garmin Dash Cam", "high", "Garmin GLV companion video extension"),
    ("a", "G64X", "genetec_g64", "Genetec Security Center", "high", "proprietary extension: .g64x"),
    ("a", "blk", "milestone_xprotect", "Milestone XProtect", "medium", "XProtect-like .blk artifact extension"),
    ("a", "265", "raw_h265_stream", "DVR/NVR raw H.265 stream", "medium", "raw H.265/HEVC-style extension: .265"),
    ("DCIM/a", "mov", "garmin_dashcam", "Garmin-like DCIM dashcam", "medium", "DCIM folder with dashcam-compatible media"),
    ("b/x_NF.", "mp4", "blackvue", "BlackVue", "high", "BlackVue-style front/rear event suffix"),
    ("b/x_nf.d/parking/a", "mp4", "thinkware_inavi", "Dashcam event-folder layout", "medium", "dashcam recording folder signal: /parking/"),
    ("b/parking/a", "mkv", "generic_media", "Generic media", "medium", "ffprobe format: matroska"),
    ("b/a", "mp4", "generic_media", "Generic media", "medium", "standard media extension: .mp4"),
    ("b/a", "", "generic_media", "Generic media", "medium", "video-like file signature"),
)


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("doc_id") % len(PROFILED) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PROFILED]), at)
    path = F.concat(pick(0), F.col("doc_id").cast("string"), F.when(pick(1) != "", F.concat(F.lit("."), pick(1))).otherwise(""))
    return V.table(spark, sf_dir, "documents").select("doc_id", R.source_profile(path, pick(1), F.when(pick(1) == "mkv", "matroska")).alias("profile"))


PLANTED_PROFILES = "planted(k, parser, vendor, confidence, evidence) AS (VALUES " + ", ".join(f"({k}, '{p[2]}', '{p[3]}', '{p[4]}', '{p[5]}')" for k, p in enumerate(PROFILED)) + ")"


@query("p8_source_profile", f"WITH {PLANTED_PROFILES} SELECT doc_id, parser, vendor, confidence, evidence FROM documents JOIN planted ON doc_id % {len(PROFILED)} = k")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).select("doc_id", "profile.parser", "profile.vendor", "profile.confidence", F.col("profile.evidence")[0].alias("evidence"))


@query("p8_parser_use", """SELECT "position", id, confidence, needles, extensions, records FROM (VALUES (0, 'dahua_dav', 'high', 3, 3), (1, 'genetec_g64', 'high', 1, 2), (3, 'hikvision', 'medium', 4, 5), (4, 'dahua_dav', 'medium', 3, 4), (6, 'thinkware_inavi', 'medium', 3, 3), (15, 'axis_onvif', 'medium', 3, 3), (21, 'avigilon_ave', 'medium', 2, 2), (19, 'milestone_xprotect', 'medium', 2, 3), (25, 'raw_h265_stream', 'medium', 0, 3)) p("position", id, confidence, needles, extensions)
JOIN (SELECT k, count(*) AS records FROM (SELECT unnest(CASE doc_id % 17 WHEN 0 THEN [3] WHEN 1 THEN [0] WHEN 2 THEN [3] WHEN 3 THEN [4] WHEN 4 THEN [15] WHEN 5 THEN [21] WHEN 6 THEN [6] WHEN 8 THEN [1] WHEN 9 THEN [19] WHEN 10 THEN [25] ELSE [] END) AS k FROM documents) GROUP BY k) n ON k = "position" """)
def p8_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parsers that records name: how many name them, how many needles and extensions they have."""
    used = R.parser_use(_profiled(spark, sf_dir)).filter("records > 0")
    return used.select("position", "id", "confidence", F.size("path_needles").alias("needles"), F.size("extensions").alias("extensions"), "records")


@query("p9_record_classes", f"""WITH {V.CATALOG} SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed' WHEN extension IN ('mp4', 'avi') THEN 'extension-candidate' ELSE 'magic-candidate' END AS confidence,
  CASE WHEN doc_id % 4 <> 0 OR doc_id % 3 = 0 OR lang = 'de' THEN 'validation-failed' ELSE 'ffprobe-video-stream-confirmed' END AS validation,
  CASE WHEN extension IN ('dav', 'ts') THEN 'proprietary extension .' || extension WHEN doc_id % 4 <> 0 THEN 'ffprobe parse failed — proprietary or corrupt container' WHEN lang = 'de' THEN 'container ''bin'' not browser-playable' WHEN lang = 'fr' AND doc_id % 3 <> 0 THEN 'codec ''mjpeg'' not browser-playable' END AS unplayable,
  CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 7 >= doc_id % 5 THEN 'intact' WHEN doc_id % 7 > 0 THEN 'partial' ELSE 'overwritten' END AS grade FROM catalog""")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    ok, form = n % 4 == 0, F.when(F.col("lang") == "de", "bin").otherwise("mov,mp4")
    codec = F.when(n % 3 != 0, F.when(F.col("lang") == "fr", "mjpeg").otherwise("h264"))
    return V.catalog(spark, sf_dir).select("id", R.confidence(ok, F.col("extension"), ("mp4", "avi")).alias("confidence"), R.validation_status(ok, codec, form).alias("validation"), R.unplayable_reason(F.col("extension"), ok, form, codec).alias("unplayable"), R.fs_grade(n % 5, n % 7).alias("grade"))


@query("p13_redact", """SELECT page_id, 'page in <case>/page/' || n || '.html and <redacted:' || substr(sha256('/home/u/My Videos/' || n || '.mp4'), 1, 16) || '> or <redacted-url:' || substr(sha256('smb://nas/u/' || n), 1, 16) || '>, <redacted:' || substr(sha256('C__Users_u_' || n || '.mp4'), 1, 16)
  || '>; see https://example.com/' || n || '/a (<redacted:' || substr(sha256('D:\\v\\' || n || '.dav'), 1, 16) || '>).' AS text FROM (SELECT page_id, page_id::VARCHAR AS n FROM pages)""")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("page in /cases/c1/page/"), n, F.lit(".html and /home/u/My Videos/"), n, F.lit(".mp4 or smb://nas/u/"), n, F.lit(", C__Users_u_"), n, F.lit(".mp4; see https://example.com/"), n, F.lit("/a (D:\\v\\"), n, F.lit(".dav)."))
    return V.table(spark, sf_dir, "pages").select("page_id", D.redact(text, "/cases/c1").alias("text"))


@query("p18_f1_search", f"WITH {RECORDS} SELECT id FROM records WHERE contains(lower(id), '00') OR contains(lower(source_path), '00') OR contains(lower(sha256), '00') OR contains(lower(status), '00')")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.search(records(spark, sf_dir), "00").select("id")


@query("f2_facet_filter", f"WITH {RECORDS} SELECT id, day FROM records WHERE kind = 'video' AND day BETWEEN '2024-01-03' AND '2024-02-10' AND (dir_path = '/evidence/src0' OR dir_path LIKE '/evidence/src0/%')")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.facet_filter(records(spark, sf_dir), kind="video", first_day="2024-01-03", last_day="2024-02-10", folder="/evidence/src0").select("id", "day")


@query("f3_chip_filter", f"""WITH {V.CATALOG}, {V.MARKS}, k AS (SELECT * FROM marks WHERE substr(id, 5)::BIGINT % 2 = 1), any_ AS (SELECT id FROM k UNION SELECT id FROM marks WHERE quality = 1 OR toxic = 1 UNION SELECT id FROM catalog WHERE doc_id % 10 = 3)
SELECT id, 'mark:none' AS chip FROM catalog WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'mark:important' FROM catalog WHERE id IN (SELECT id FROM k WHERE status = 'important')
UNION ALL SELECT id, 'tag:good' FROM catalog WHERE id IN (SELECT id FROM marks WHERE quality = 1) UNION ALL SELECT id, 'marked:any' FROM catalog WHERE id IN (SELECT id FROM any_)
UNION ALL SELECT id, 'anomaly' FROM catalog WHERE doc_id % 3 = 0 UNION ALL SELECT id, 'anomaly:unauth' FROM catalog WHERE doc_id % 6 = 0 UNION ALL SELECT id, 'anomaly:pc' FROM catalog WHERE doc_id % 9 = 0
UNION ALL SELECT id, 'warning' FROM catalog WHERE doc_id % 4 = 1 UNION ALL SELECT id, 'kind:recovery' FROM catalog WHERE doc_id % 4 > 0""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    c = V.catalog(spark, sf_dir).withColumns({
        "has_anomaly": n % 3 == 0, "has_unauth_anomaly": n % 6 == 0, "has_pc_anomaly": F.when(n % 9 == 0, True), "warnings": F.when(n % 4 == 1, F.array(F.lit("w"))).when(n % 4 == 2, F.array().cast("array<string>")),
        "record_kind": F.element_at(F.array(*map(F.lit, ("video", "candidate", "filesystem", "repaired"))), (n % 4 + 1).cast("int")),
    })
    marks = V.marks(spark, sf_dir).filter("cast(substr(id, 5) as long) % 2 = 1")
    notes = c.select("id", F.when(n % 10 == 3, "seen").when(n % 10 == 4, "  ").alias("note"))
    chips = ("mark:none", "mark:important", "tag:good", "marked:any", "anomaly", "anomaly:unauth", "anomaly:pc", "warning", "kind:recovery")
    return reduce(DataFrame.unionByName, [T.chip_filter(c, marks, V.tags(spark, sf_dir), chip, notes).select("id", F.lit(chip).alias("chip")) for chip in chips])


@query("f4_sorted_page", f"WITH {RECORDS} SELECT id, modified_unix FROM records ORDER BY modified_unix DESC NULLS LAST, id LIMIT 200 OFFSET 100")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is the feature here: the limit is the page's length."""
    return T.page(records(spark, sf_dir), [F.col("rec_ts").desc_nulls_last(), F.col("id")], 100, 200).select("id", "modified_unix")


@query("a1_case_summary", f"WITH {V.JOBS}, l AS (SELECT job, max_by(status, seq) AS status FROM jobs GROUP BY job) SELECT (SELECT count(*) FROM documents) AS videos, (SELECT count(*) FROM orders) AS runs, (SELECT count(*) FROM supplier) AS sources, count(*) AS jobs, count(*) FILTER (status = 'running') AS running_jobs FROM l")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.job_events(spark, sf_dir).groupBy("job").agg(F.max_by("status", "seq").alias("status"))
    return T.case_summary(V.catalog(spark, sf_dir), V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "supplier"), jobs)


@query("a2_hash_coverage", f"WITH {V.CATALOG} SELECT count(*) AS total, count(sha256) AS hashed, count(*) FILTER (sha256 IS NULL AND doc_id % 2 = 0) AS errors FROM catalog")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hash_coverage(V.catalog(spark, sf_dir).withColumn("hash_status", F.when(F.col("sha256").isNull() & (F.col("doc_id") % 2 == 0), "failed")))


@query("a3_facet_counts", f"""WITH {RECORDS} SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM records WHERE lang = 'en' AND status = 'none' GROUP BY kind
UNION ALL SELECT 'lang', lang, count(*) FROM records WHERE kind = 'video' AND status = 'none' GROUP BY lang UNION ALL SELECT 'status', status, count(*) FROM records WHERE kind = 'video' AND lang = 'en' GROUP BY status
UNION ALL SELECT 'day', coalesce(day, 'none'), count(*) FROM records WHERE kind = 'video' AND lang = 'en' AND status = 'none' GROUP BY day""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.facet_counts(records(spark, sf_dir), {"kind": "video", "lang": "en", "status": "none", "day": None})


@query("a4_group_counts", f"WITH {RECORDS} SELECT coalesce(day, 'none') AS value, count(*) AS n FROM records GROUP BY day")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.group_counts(records(spark, sf_dir), "day")


@query("a5_mark_tally", f"WITH {V.CATALOG}, {V.MARKS}, c AS (SELECT id FROM catalog WHERE doc_id % 3 > 0) SELECT status, count(*) AS marks, count(*) FILTER (id IN (SELECT id FROM c)) AS listed, count(*) FILTER (id NOT IN (SELECT id FROM c)) AS off_case FROM marks GROUP BY status")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mark_tally(V.marks(spark, sf_dir), V.catalog(spark, sf_dir).filter("doc_id % 3 > 0"))


@query("a6_band_distribution", f"""WITH {V.CATALOG} SELECT CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN doc_id % 10 = 1 THEN 'failed' WHEN doc_id % 10 = 3 THEN 'unknown' WHEN size_bytes % 100 >= 70 THEN 'high' WHEN size_bytes % 100 >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM catalog GROUP BY 1""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    reports = c.filter("doc_id % 4 <> 0").select("id", F.when(F.col("doc_id") % 10 == 1, "failed").otherwise("done").alias("status"), F.when(F.col("doc_id") % 10 != 3, (F.col("size_bytes") % 100) / 100).alias("score"))
    return T.band_distribution(c, reports)


@query("a7_day_histogram", f"WITH {RECORDS} SELECT substr(day, 1, 7) AS month, day, count(*) AS n FROM records WHERE day IS NOT NULL GROUP BY day")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.day_histogram(records(spark, sf_dir))


@query("a8_frames_by_channel", f"""WITH {V.FRAMES}, f AS (SELECT *, event_ok FROM (SELECT *, "offset" % 7 > 0 AS v, true AS event_ok FROM frames) WHERE file NOT IN (SELECT file FROM frames WHERE "offset" % 1999 = 0)),
p AS (SELECT file, channel, count(*) FILTER (v) AS video_frames, count(*) FILTER (NOT v) AS audio_frames, min("offset") FILTER (v) AS at FROM f GROUP BY file, channel)
SELECT file, channel, video_frames, audio_frames, (SELECT min_by(q.channel, q.at) FROM p q WHERE q.file = p.file AND q.at IS NOT NULL) AS first_channel FROM p""")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.frames(spark, sf_dir).withColumns({"is_video": F.col("offset") % 7 > 0, "failed": F.col("offset") % 1999 == 0})
    return T.frames_by_channel(f)


BLOCKS = "b AS (SELECT user_id AS id, event_id % 2 AS stream, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1000 + event_id % 500 END AS n_samples, -value AS max_db, -value - 10 AS mean_db FROM events)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return V.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (n % 2).alias("stream"), F.when(n % 11 == 0, 0).otherwise(1000 + n % 500).alias("n_samples"), (-F.col("value")).alias("max_db"), (-F.col("value") - 10).alias("mean_db"))


@query("a9_loudness", f"""WITH {BLOCKS} SELECT id, stream, coalesce(sum(n_samples), 0)::BIGINT AS n_samples, round(max(max_db) FILTER (n_samples > 0), 6) AS peak_db,
  round(10 * log10(sum(n_samples * pow(10.0, mean_db / 10)) FILTER (n_samples > 0) / sum(n_samples)), 6) AS mean_db, CASE WHEN sum(n_samples) > 0 THEN 'measured' ELSE 'error' END AS state FROM b GROUP BY id, stream""")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.loudness(_blocks(spark, sf_dir), ["id", "stream"])
    return d.withColumns({"peak_db": F.round("peak_db", 6), "mean_db": F.round("mean_db", 6)})


@query("a10_record_verdict", f"""WITH {BLOCKS}, s AS (SELECT id, stream, sum(n_samples) AS n, max(max_db) FILTER (n_samples > 0) AS peak FROM b GROUP BY id, stream),
r AS (SELECT id, bool_or(n > 0 AND id % 9 > 0 AND peak > -70) AS a, bool_and(n > 0 AND id % 9 > 0 AND peak <= -70) AS z FROM s WHERE id % 4 > 0 GROUP BY id), u AS (SELECT DISTINCT id FROM b)
SELECT u.id, CASE WHEN r.id IS NULL THEN 'no-audio' WHEN a THEN 'sound' WHEN z THEN 'silent' ELSE 'error' END AS verdict FROM u LEFT JOIN r ON u.id = r.id""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    s = T.loudness(b.filter("id % 4 > 0"), ["id", "stream"]).withColumns({"track_s": F.lit(10.0), "measured_s": F.when(F.col("id") % 9 > 0, 10.0).otherwise(5.0)})
    return T.record_verdict(s, b.select("id").distinct())


@query("a12_track_summary", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id AS file, count(*) FILTER (n <= 20000) AS kept, count(*) AS total, count(*) > 20000 AS truncated, min(epoch(ts)::BIGINT) FILTER (n <= 20000) AS first_ts, max(epoch(ts)::BIGINT) FILTER (n <= 20000) AS last_ts, max(value) FILTER (n <= 20000) AS max_speed FROM p GROUP BY user_id""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("offset"), F.round(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("ts"), F.col("value").alias("speed"))
    return T.track_summary(e)


@query("a14_grade_counts", f"WITH {V.CATALOG} SELECT CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 7 >= doc_id % 5 THEN 'intact' WHEN doc_id % 7 > 0 THEN 'partial' ELSE 'overwritten' END AS grade, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM catalog GROUP BY 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return T.grade_counts(V.catalog(spark, sf_dir).withColumn("grade", R.fs_grade(n % 5, n % 7)))


@query("a18_set_fingerprint", f"WITH {V.CATALOG} SELECT parent_dir, count(DISTINCT sha256)::INTEGER AS n, sha256(coalesce(string_agg(DISTINCT sha256, chr(10) ORDER BY sha256), '')) AS digest FROM catalog GROUP BY parent_dir")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ordered_fingerprint(V.catalog(spark, sf_dir), "parent_dir", "sha256")


@query("a19_carve_run_listing", """WITH l AS (SELECT CASE WHEN o_custkey % 9 > 0 THEN 'run' || (o_custkey % 9)::VARCHAR END AS run_id, o_custkey AS id, o_orderkey AS line_no, o_orderstatus AS status, epoch(o_orderdate)::BIGINT AS ts FROM orders),
r AS (SELECT run_id, max(ts) AS t FROM l GROUP BY run_id), k AS (SELECT run_id, dense_rank() OVER (ORDER BY run_id IS NULL, t DESC, run_id) AS run_rank FROM r), e AS (SELECT run_id, id, max_by(status, line_no) AS status FROM l GROUP BY run_id, id)
SELECT run_rank::INTEGER AS run_rank, e.run_id, id, status FROM e JOIN k ON e.run_id IS NOT DISTINCT FROM k.run_id""")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    run = F.when(F.col("o_custkey") % 9 > 0, F.concat(F.lit("run"), (F.col("o_custkey") % 9).cast("string")))
    return T.carve_run_listing(o.select(run.alias("run_id"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts")))


@query("a21_gate_report", f"""WITH {V.CATALOG}, c AS (SELECT 'hashes' AS "check", CASE WHEN count(*) FILTER (sha256 IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM catalog UNION ALL SELECT 'ids', CASE WHEN count(*) = count(DISTINCT id) THEN 'PASS' ELSE 'FAIL' END FROM catalog UNION ALL SELECT 'anchors', 'BLOCKED')
SELECT * FROM c UNION ALL SELECT 'overall', CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'BLOCKED') THEN 'BLOCKED' ELSE 'PASS' END FROM c""")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    checks = c.agg((F.count_if(F.col("sha256").isNull()) == 0).alias("ok")).select(F.lit("hashes").alias("check"), F.lit(True).alias("ready"), "ok")
    checks = checks.unionByName(c.agg((F.count("*") == F.count_distinct("id")).alias("ok")).select(F.lit("ids").alias("check"), F.lit(True).alias("ready"), "ok"))
    missing = c.filter("false").agg(F.count("*").alias("n")).select(F.lit("anchors").alias("check"), (F.col("n") > 0).alias("ready"), F.lit(None).cast("boolean").alias("ok"))
    return T.gate_report(checks.unionByName(missing))


@query("a21_release_gate", f"""WITH {V.CASES}, pass(ok, name) AS (
SELECT count(*) = 0, 'report_defense' FROM (SELECT source, doc_id % 97 FROM catalog EXCEPT SELECT source, doc_id % 97 FROM catalog WHERE doc_id % 3 = 0) UNION ALL SELECT true, 'reproducibility'
UNION ALL SELECT count(*) * 60000 // max(o_orderkey) >= 50000, 'performance' FROM orders UNION ALL SELECT count(*) > 0, 'audit_chain' FROM conversations
UNION ALL SELECT count(*) FILTER (a.id IS NULL OR b.id IS NULL OR a.source_path <> b.source_path OR a.sha256 <> b.sha256) = 0, 'consistency' FROM case_a a FULL JOIN case_b b ON a.id = b.id),
c AS (SELECT name AS "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict FROM pass UNION ALL SELECT 'accuracy', 'BLOCKED')
SELECT * FROM c UNION ALL SELECT 'overall', CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' ELSE 'BLOCKED' END FROM c""")
def a21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No list of expected files is given, so accuracy is blocked."""
    a, b = V.cases(spark, sf_dir)
    c = V.catalog(spark, sf_dir).select(F.col("source").alias("case_id"), F.concat(F.lit("reports/"), (F.col("doc_id") % 97).cast("string")).alias("path"), "doc_id")
    lines = V.lane_lines(spark, sf_dir, damage=False)
    heads = N.verify_chain(lines)
    return T.release_gate(
        missing_artifacts=L.required_artifacts(c.select("case_id", "path").distinct(), c.filter("doc_id % 3 = 0")),
        reproducibility=U.reproducible(a, V.cases(spark, sf_dir)[0].orderBy("id")),
        performance=V.table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("elapsed_ms")),
        audit_chain=N.check_anchors(heads, lines, heads.select("lane", "entries", "head")),
        consistency=L.consistency(a, b),
    )


@query("u2_all_records", f"WITH {V.CATALOG} SELECT id, sha256, NULL AS original_path, 'video' AS record_kind FROM catalog WHERE doc_id % 2 = 0 UNION ALL SELECT id, NULL, source_path, 'carved' FROM catalog WHERE doc_id % 2 = 1")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    return T.all_records(("video", c.filter("doc_id % 2 = 0").select("id", "sha256")), ("carved", c.filter("doc_id % 2 = 1").select("id", F.col("source_path").alias("original_path"))))


@query("u5_all_findings", f"""WITH {V.CATALOG}, d AS (SELECT id, source_path, modified_unix - lag(modified_unix) OVER (PARTITION BY parent_dir ORDER BY source_path, id) AS delta FROM catalog WHERE modified_unix > 0)
SELECT CASE WHEN delta < 0 THEN 'regression' ELSE 'gap' END AS kind, id AS selector, source_path, delta::VARCHAR AS detail, 'mtime' AS detector FROM d WHERE delta < 0 OR delta > 604800 
UNION ALL SELECT 'hash-mismatch', id, source_path, CASE WHEN doc_id % 8 = 0 THEN 'missing' ELSE 'mismatch' END, 'rehash' FROM catalog WHERE doc_id % 8 = 0 OR (doc_id % 6 = 0 AND sha256 IS NOT NULL) UNION ALL SELECT 'no-findings', NULL, NULL, NULL, 'frames'""")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.linkage import rehash_check
    from ..operators.sequence import frame_gap_findings, timestamp_findings

    c = V.catalog(spark, sf_dir)
    f = timestamp_findings(c).join(c.select("id", "source_path"), "id").select("kind", F.col("id").alias("selector"), "source_path", F.col("delta").alias("detail"))
    now = c.filter("doc_id % 8 <> 0").withColumns({"sha256": F.when(F.col("doc_id") % 6 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")), "readable": F.lit(True)})
    checked = rehash_check(c, now).filter("result in ('mismatch', 'missing')").join(c.select("id", "source_path"), "id")
    rehash = checked.select(F.lit("hash-mismatch").alias("kind"), F.col("id").alias("selector"), "source_path", F.col("result").alias("detail"))
    frames = frame_gap_findings(V.frames(spark, sf_dir).filter("seconds is not null"), gap=1 << 40).filter("kind = 'gap'")
    frames = frames.select("kind", F.col("file").alias("selector"), F.col("channel").alias("source_path"), F.col("delta").alias("detail"))
    return T.all_findings({"mtime": f, "rehash": rehash, "frames": frames})


@query("j12_attach_findings", f"""WITH {V.CATALOG}, f AS (SELECT DISTINCT printf('vid_%06d', event_id % 700 + 1) AS selector, event_type AS kind, value < 20 AS usable FROM events),
g AS (SELECT selector, list_sort(list(DISTINCT kind)) AS kinds, bool_or(usable) AS usable FROM f GROUP BY selector)
SELECT c.id, coalesce(kinds, []::VARCHAR[]) AS kinds, coalesce(usable, false) AS usable FROM catalog c LEFT JOIN g ON c.id = g.selector""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.linkage import attach_findings

    f = V.table(spark, sf_dir, "events").select(V.record_id(F.col("event_id") % 700).alias("selector"), F.col("event_type").alias("kind"), (F.col("value") < 20).alias("usable"))
    return attach_findings(V.catalog(spark, sf_dir), f)


@query("s1_read_records", "SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 > 1) AS records, count(*) FILTER (doc_id % 10 = 0) AS bad_lines, count(*) FILTER (doc_id % 10 = 1) AS without_id, count(*) FILTER (doc_id % 10 = 3) AS stale FROM documents")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    good = F.to_json(F.struct(F.when(F.col("doc_id") % 10 != 1, F.col("id")).alias("id"), "source_path", "size_bytes", "modified_unix", F.when(F.col("doc_id") % 10 == 3, "stale").alias("index_status")))
    lines = c.select(F.when(F.col("doc_id") % 10 == 0, F.substring(good, 1, 20)).otherwise(good).alias("value"))
    return readers.split_records(readers.records_from_lines(lines))[1]


@query("s4_read_hash_list", f"WITH {V.CATALOG} SELECT DISTINCT sha256 FROM catalog WHERE sha256 IS NOT NULL AND doc_id % 4 > 0")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir).filter("sha256 is not null")
    line = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# "), "sha256")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('"'), F.upper("sha256"), F.lit('","x.mp4",1'))).otherwise(F.col("sha256"))
    return readers.hashes_from_lines(c.select(line.alias("value")))[0]


@query("s6_read_fs_listing", """WITH l AS (SELECT * FROM documents WHERE doc_id % 9 > 0) SELECT CASE WHEN doc_id % 8 = 0 THEN 'd/d' ELSE 'r/r' END AS type, doc_id::VARCHAR || '-128-1' AS inode, 'dir/clip' || doc_id::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '.mp4' ELSE '.txt' END AS path,
  doc_id % 3 = 0 AS deleted, doc_id % 2 = 0 AND doc_id % 8 > 0 AS video_candidate, n_chars AS size_bytes FROM l""")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = V.table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    i = F.col("doc_id")
    head = F.concat(F.when(i % 8 == 0, "d/d ").otherwise("r/r "), F.when(i % 3 == 0, "* ").otherwise(""), n, F.lit("-128-1:"))
    line = F.concat_ws("\t", head, F.concat(F.lit("dir/clip"), n, F.when(i % 2 == 0, ".mp4").otherwise(".txt")), F.lit("t"), F.lit("t"), F.lit("t"), F.lit("t"), F.col("n_chars").cast("string"), F.lit("0"), F.lit("0"))
    return readers.listing_from_lines(d.select(F.when(i % 9 == 0, "garbage").otherwise(line).alias("value")))[0]


@query("s10_newest_snapshot", "WITH f AS (SELECT l_suppkey % 40 AS case_id, 'inspect-' || strftime(l_shipdate, '%Y%m%d') AS file_name, l_orderkey AS item FROM lineitem) SELECT * FROM f WHERE file_name = (SELECT max(g.file_name) FROM f g WHERE g.case_id = f.case_id)")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = V.table(spark, sf_dir, "lineitem")
    return readers.newest_snapshot(l.select((F.col("l_suppkey") % 40).alias("case_id"), F.concat(F.lit("inspect-"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyyMMdd")).alias("file_name"), F.col("l_orderkey").alias("item")))


@query("s12_file_objects", f"WITH {V.CATALOG} SELECT source_path AS filename, size_bytes AS filesize, modified_unix AS mtime, sha256 AS hashdigest FROM catalog WHERE size_bytes IS NOT NULL")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.file_objects(V.catalog(spark, sf_dir))[0]


@query("s13_safe_csv", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '''=' || c_name WHEN c_custkey % 4 = 1 THEN '-12.5' WHEN c_custkey % 4 = 2 THEN '''@' || c_name ELSE c_name END AS cell FROM customer")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cell = F.when(k % 4 == 0, F.concat(F.lit("="), "c_name")).when(k % 4 == 1, "-12.5").when(k % 4 == 2, F.concat(F.lit("@"), "c_name")).otherwise(F.col("c_name"))
    return sinks.safe_csv(V.table(spark, sf_dir, "customer").select("c_custkey", cell.alias("cell")))
