"""Queries over logs, merges and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lanes as L
from ..operators import maintain as M
from ..session import written
from . import views as V
from .registry import query


@query("w12_current_entries", f"""WITH {V.ENTRIES}, g AS (SELECT lane, 'id=' || id AS key, max(line_no) AS line_no, max_by(usable, line_no) AS usable, max(line_no) FILTER (usable) AS lu FROM entries GROUP BY ALL)
SELECT lane, key, line_no, usable, NOT usable AND lu IS NOT NULL AS superseded FROM g""")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.log_entries(spark, sf_dir)
    keyed = e.withColumn("key", F.explode(L.recency_keys(F.col("lane").cast("string"), F.col("body"))))
    return L.current_entries(keyed)


@query("w13_measurement_latest", f"""WITH {V.ENTRIES}, r AS (SELECT lane, max(line_no) AS rep FROM entries WHERE is_repair GROUP BY lane),
m AS (SELECT e.id AS selector, e.lane, line_no, ts, CASE WHEN line_no <= rep THEN 'unverified' WHEN usable THEN 'authenticated' ELSE 'self-consistent' END AS trust FROM entries e LEFT JOIN r ON e.lane = r.lane WHERE NOT is_repair),
k AS (SELECT selector, list_sort(list(struct_pack(ts := ts, lane := lane, line_no := line_no, rank := CASE trust WHEN 'unverified' THEN 0 WHEN 'self-consistent' THEN 1 ELSE 2 END, trust := trust))) AS es FROM m GROUP BY selector),
z AS (SELECT selector, list_reduce(es, lambda a, x: CASE WHEN a.rank > x.rank AND NOT (a.lane = x.lane AND x.rank = 0) THEN a ELSE x END) AS b FROM k)
SELECT selector, b.lane AS lane, b.line_no AS line_no, b.trust AS trust, b.ts AS value FROM z""")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.log_entries(spark, sf_dir)
    return L.measurement_latest(e.select(F.col("id").alias("selector"), "lane", "line_no", "is_repair", F.when(F.col("usable"), "authenticated").otherwise("self-consistent").alias("trust"), "ts", F.col("ts").alias("value")))


@query("w14_run_result", f"""WITH {V.ENTRIES}, r AS (SELECT lane, run_id, min(line_no) AS lo, max(line_no) AS hi, max(line_no) FILTER (is_marker AND usable) AS m, max(ts) AS ts FROM entries GROUP BY lane, run_id),
w AS (SELECT lane, arg_max(struct_pack(run_id := run_id, lo := lo, hi := hi, m := m, ts := ts), m) AS w FROM r WHERE m IS NOT NULL GROUP BY lane),
o AS (SELECT r.lane, bool_or(r.m IS NULL AND r.hi > w.w.hi) AS a, bool_or(r.m IS NOT NULL AND r.lo <= w.w.hi AND r.hi >= w.w.lo) AS b FROM r JOIN w ON r.lane = w.lane WHERE r.run_id <> w.w.run_id GROUP BY r.lane),
x AS (SELECT e.lane, bool_or(NOT usable) AS c, bool_or(is_repair) AS d FROM entries e JOIN w ON e.lane = w.lane WHERE line_no > w.w.m GROUP BY e.lane),
f AS (SELECT w.lane, w.w.run_id AS run_id, list_filter([CASE WHEN a THEN 'newer-unfinished-run' END, CASE WHEN b THEN 'overlapping-run' END, CASE WHEN c THEN 'unusable-after-marker' END, CASE WHEN d THEN 'repair-after-marker' END], lambda z: z IS NOT NULL) AS reasons, w.w.ts > 1700300000 + 600 AS clock_anomaly
      FROM w LEFT JOIN o ON w.lane = o.lane LEFT JOIN x ON w.lane = x.lane)
SELECT lane, run_id, len(reasons) > 0 AS withheld, reasons, clock_anomaly FROM f""")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_result(V.log_entries(spark, sf_dir), now=1_700_300_000)


@query("w15_verify_chain", """WITH l AS (SELECT conv_id AS lane, count(*) AS entries, conv_id % 5 = 0 AND count(*) >= 2 AS cut, conv_id % 8 IN (3, 4, 5) AS tail FROM conversations GROUP BY conv_id)
SELECT lane, entries, CASE WHEN cut THEN 2 WHEN tail THEN entries END AS first_bad, CASE WHEN cut AND NOT (tail AND entries = 2) THEN 'entry-hash-mismatch' WHEN tail THEN 'entry-hash-misplaced' END AS reason,
  CASE WHEN cut OR tail THEN 'broken' ELSE 'intact' END AS status FROM l""")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.verify_chain(V.lane_lines(spark, sf_dir, tails=True)).drop("head")


#: Lines n of lanes of k lines, and what a reader who holds k1 finds: kinds of lanes by conv_id modulo 6, as `views.lane_lines` makes them.
TRUST = """l AS (SELECT conv_id AS lane, turn + 1 AS n, count(*) OVER (PARTITION BY conv_id) AS k, conv_id % 6 AS kind FROM conversations),
d AS (SELECT *, k >= 2 AND (kind = 5 OR broken) AS cut FROM (SELECT *, {broken} AS broken FROM l)),
t AS (SELECT *, CASE WHEN cut AND n >= 2 THEN 'chain-broken' WHEN kind = 4 THEN CASE WHEN n = 1 THEN 'authenticated' ELSE 'rewrite-not-excluded' END
  WHEN kind = 0 OR cut OR k = 1 OR (kind = 3 AND n = 1) THEN 'not-authenticated' WHEN kind = 2 THEN 'other-key' WHEN kind = 1 AND n = 1 THEN 'pre-key' ELSE 'authenticated' END AS trust FROM d)"""
RING = {"k1": V.LANE_KEYS["k1"]}


@query("w16_trust_counts", f"WITH {TRUST.format(broken='lane % 5 = 0')} SELECT lane, trust, count(*) AS n FROM t GROUP BY 1, 2")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trust_counts(L.line_trust(V.lane_lines(spark, sf_dir, keyed=True), RING))


@query("w16_key_generations", """WITH l AS (SELECT conv_id AS lane, conv_id % 4 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT lane, n AS line_no, CASE WHEN kind = 3 OR (kind < 2 AND k < 3) OR (kind = 2 AND k = 1) THEN 'not-authenticated' WHEN (kind = 1 AND n >= 4) OR (kind = 2 AND n >= 3) THEN 'chain-broken' ELSE 'authenticated' END AS trust FROM l""")
def w16c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes over a rotation of keys: proper ones, rewound ones, and ones that only the retired key signs."""
    return L.line_trust(V.lane_lines(spark, sf_dir, damage=False, rotation=True), {k: V.LANE_KEYS[k] for k in ("k0", "k1")}, {"k0": 1_700_000_000})


@query("w16_trust_without_keys", """WITH l AS (SELECT conv_id AS lane, turn + 1 AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT lane, CASE WHEN lane % 5 = 0 AND k >= 2 AND n >= 2 THEN 'chain-broken' ELSE 'self-consistent' END AS trust, count(*) AS n FROM l GROUP BY 1, 2""")
def w16b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trust_counts(L.line_trust(V.lane_lines(spark, sf_dir, keyed=True), {}))


@query("j20_check_anchors", f"""WITH {TRUST.format(broken='lane % 5 = 0')}, g AS (SELECT lane, k, cut, bool_or(n = 1 AND trust IN ('authenticated', 'pre-key')) AS one, bool_and(trust IN ('authenticated', 'pre-key')) AS every FROM t GROUP BY ALL)
SELECT lane, CASE WHEN lane % 7 = 0 THEN 'truncated' WHEN lane % 11 = 0 THEN 'rewritten' WHEN lane % 2 = 1 THEN CASE WHEN one AND NOT (lane % 5 = 0 AND k >= 2) THEN 'intact' ELSE 'not-authenticated' END
  WHEN lane % 5 = 0 AND k >= 2 THEN 'rewritten' WHEN every THEN 'intact' ELSE 'not-authenticated' END AS state FROM g UNION ALL SELECT -1, 'missing'""")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors at the first line of odd lanes and at the last of even ones; some are one line too long or hold another hash."""
    lines = V.lane_lines(spark, sf_dir, keyed=True)
    heads, lane = L.verify_chain(lines), F.col("lane")
    first = L.parse_lines(lines).filter("line_no = 1").select(lane.alias("_lane"), F.col("entry").alias("_first"))
    odd = lane % 2 == 1
    entries = F.when(lane % 7 == 0, F.col("entries") + 1).when(odd, 1).otherwise(F.col("entries"))
    anchors = heads.join(first, lane == F.col("_lane")).select("lane", entries.alias("entries"), F.when(lane % 11 == 0, "x").when(odd, F.col("_first")).otherwise(F.col("head")).alias("head"))
    gone = heads.agg(F.lit(-1).cast("long").alias("lane"), F.lit(1).cast("long").alias("entries"), F.lit("x").alias("head"))
    return L.check_anchors(heads, lines, anchors.unionByName(gone), L.line_trust(lines, RING))


@query("j20_advance_anchors", f"""WITH {TRUST.format(broken='false')}, g AS (SELECT lane, k, bool_and(trust IN ('authenticated', 'pre-key')) AS good, bool_and(trust = 'authenticated') AS auth FROM t GROUP BY ALL)
SELECT lane, CASE WHEN good THEN k ELSE 1 END AS entries, CASE WHEN auth THEN 'authenticated' WHEN good THEN 'self-consistent' ELSE 'anchor-kept' END AS integrity FROM g WHERE good OR lane % 2 = 1""")
def j20b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lanes have an anchor at their first line."""
    lines = V.lane_lines(spark, sf_dir, keyed=True, damage=False)
    anchors = L.parse_lines(lines).filter("line_no = 1 and lane % 2 = 1").select("lane", F.lit(1).cast("long").alias("entries"), F.col("entry").alias("head"))
    return L.advance_anchors(L.verify_chain(lines), L.line_trust(lines, RING), anchors).drop("head")


@query("a22_pair_lifecycle", f"""WITH {V.ENTRIES}, g AS (SELECT lane, id, max(line_no) FILTER (event = 'begin') AS b, max(line_no) FILTER (event = 'complete') AS c, max(line_no) FILTER (event = 'resolve') AS r FROM entries GROUP BY lane, id),
x AS (SELECT *, max(b) OVER (PARTITION BY lane) AS lb FROM g)
SELECT lane, id, CASE WHEN b IS NULL THEN 'unpaired' WHEN greatest(coalesce(c, 0), coalesce(r, 0)) > b THEN CASE WHEN coalesce(r, 0) > coalesce(c, 0) THEN 'resolved' ELSE 'completed' END WHEN b = lb THEN 'open' ELSE 'unpaired' END AS state FROM x""")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pair_lifecycle(V.log_entries(spark, sf_dir))


@query("m1_upsert_catalog", f"""WITH {V.CASES}, c AS (SELECT id, source_path, sha256, 100 + doc_id AS fi, 100 + doc_id AS li FROM case_a), n AS (SELECT CASE WHEN doc_id % 6 = 0 THEN id || 'n' ELSE id END AS id, source_path, sha256 FROM case_b)
SELECT n.id, n.source_path, n.sha256, least(coalesce(i.fi, p.fi, 5000000), coalesce(p.fi, i.fi, 5000000)) AS first_indexed, 5000000::BIGINT AS last_indexed FROM n LEFT JOIN c i ON n.id = i.id LEFT JOIN c p ON n.source_path = p.source_path
UNION ALL SELECT id, source_path, sha256, fi, li FROM c WHERE id NOT IN (SELECT id FROM n) AND source_path NOT IN (SELECT source_path FROM n)""")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    cur = a.select("id", "source_path", "sha256", (F.col("doc_id") + 100).alias("first_indexed"), (F.col("doc_id") + 100).alias("last_indexed"))
    return M.upsert_catalog(cur, b.withColumn("id", F.when(F.col("doc_id") % 6 == 0, F.concat("id", F.lit("n"))).otherwise(F.col("id"))), 5_000_000)


@query("m2_merge_cases", f"""WITH {V.CASES}, a AS (SELECT doc_id + 999950 AS n, 'vid_' || (doc_id + 999950)::VARCHAR AS id, source_path AS path_key, sha256 FROM case_a), b AS (SELECT doc_id + 999950 AS n, 'vid_' || (doc_id + 999950)::VARCHAR AS id, source_path AS path_key, sha256 FROM case_b), t AS (SELECT max(n) AS top FROM a),
f AS (SELECT top + row_number() OVER (ORDER BY b.n, path_key) AS n, path_key, sha256, b.id AS old FROM b, t WHERE path_key NOT IN (SELECT path_key FROM a)),
r AS (SELECT a.n, a.path_key, a.sha256, NULL AS merged_from, NULL AS merged_from_id, 0 AS src, CASE WHEN b.id IS NULL THEN []::VARCHAR[] ELSE ['b:' || b.id] END AS provenance FROM a LEFT JOIN b ON a.path_key = b.path_key
      UNION ALL SELECT n, path_key, sha256, 'b', old, 1, ['b:' || old] FROM f),
d AS (SELECT *, 'vid_' || n::VARCHAR AS id, 'vid_' || first(n) OVER (PARTITION BY sha256 ORDER BY src, n)::VARCHAR AS fi FROM r)
SELECT id, path_key, sha256, merged_from, merged_from_id, provenance, CASE WHEN sha256 IS NOT NULL AND fi <> id THEN fi END AS duplicate_of FROM d""")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from six digits into seven."""
    own = F.format_string("vid_%06d", F.col("doc_id") + 999_950)
    a, b = (df.select(own.alias("id"), F.col("source_path").alias("path_key"), "sha256") for df in V.cases(spark, sf_dir))
    return M.merge_cases(a, [("b", b)])


@query("m3_merge_marks", f"""WITH {V.MARKS}, t AS (SELECT id, status, 'note a' AS note FROM marks WHERE toxic = 0), s AS (SELECT 's' || id AS sid, id, CASE WHEN quality = 1 THEN 'noted' ELSE status END AS status, 'note b' AS note FROM marks), m AS (SELECT * FROM s WHERE NOT ends_with(id, '7'))
SELECT coalesce(t.id, m.id) AS id, coalesce(t.status, m.status) AS status, concat_ws(chr(10), t.note, m.note) AS note, CASE WHEN t.id IS NOT NULL AND m.id IS NOT NULL AND t.status <> m.status THEN 'conflict' WHEN t.id IS NOT NULL THEN 'target' ELSE 'source' END AS outcome FROM t FULL JOIN m ON t.id = m.id
UNION ALL SELECT sid, status, note, 'unmapped' FROM s WHERE ends_with(id, '7')""")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "labels")
    m = V.marks(spark, sf_dir).join(labels.select(V.record_id(F.col("doc_id")).alias("id"), "toxic", "quality"), "id")
    target = m.filter("toxic = 0").select("id", "status", F.lit("note a").alias("note"))
    source = m.select(F.concat(F.lit("s"), "id").alias("id"), F.when(F.col("quality") == 1, "noted").otherwise(F.col("status")).alias("status"), F.lit("note b").alias("note"))
    ids = m.filter(~F.col("id").endswith("7")).select(F.concat(F.lit("s"), "id").alias("source_id"), F.col("id").alias("target_id"))
    return M.merge_marks(target, source, ids)


#: b: each labelled record, with the target's note (t: only of records that are not toxic) and the source's tags; m: those that are mapped.
BOTH = f"""{V.MARKS}, b AS (SELECT id, substr(id, 5)::BIGINT AS n, toxic = 0 AS t, status, CASE WHEN quality = 1 THEN 'noted' ELSE status END AS s, CASE WHEN substr(id, 5)::BIGINT % 3 > 0 THEN 'note a' END AS note,
  CASE WHEN quality = 1 THEN ['good'] ELSE []::VARCHAR[] END AS had, list_sort(list_concat(CASE WHEN toxic = 1 THEN ['flag'] ELSE []::VARCHAR[] END, CASE WHEN substr(id, 5)::BIGINT % 4 = 0 THEN ['good', 'x'] ELSE []::VARCHAR[] END)) AS tags FROM marks),
m AS (SELECT *, list_sort(list_distinct(list_concat(had, tags))) AS united FROM b WHERE NOT ends_with(id, '7'))"""


def _merged(spark: SparkSession, sf_dir: str, times: int = 2) -> tuple[M.Annotations, DataFrame]:
    labels = V.table(spark, sf_dir, "labels").select(V.record_id(F.col("doc_id")).alias("id"), "toxic", "quality")
    b = V.marks(spark, sf_dir).join(labels, "id").withColumn("n", F.substr("id", F.lit(5)).cast("long"))
    n, old = F.col("n"), F.concat(F.lit("s"), "id")
    mark = lambda key, status, note: [key.alias("id"), status.alias("status"), F.lit(100).cast("long").alias("marked_unix"), F.lit("kim").alias("examiner"), note.alias("note"), F.lit(None).cast("double").alias("range_in"), F.lit(None).cast("double").alias("range_out")]
    some = lambda ok, *names: F.when(ok, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    past = b.filter(n % 5 == 0).withColumn("history_pk", F.explode(F.array(F.lit(1), F.lit(2))))
    past = past.select(old.alias("id"), "history_pk", F.lit("mark").alias("action"), F.lit(50).cast("long").alias("changed_unix"), F.lit(None).cast("string").alias("old_status"), F.col("status").alias("new_status"), F.lit(None).cast("string").alias("old_note"), F.lit("note b").alias("new_note"), F.when(F.col("history_pk") == 1, "why").alias("detail"))
    source = M.Annotations(b.select(*mark(old, F.when(F.col("quality") == 1, F.lit("noted")).otherwise(F.col("status")), F.lit("note b"))), b.select(old.alias("id"), F.concat(some(F.col("toxic") == 1, "flag"), some(n % 4 == 0, "good", "x")).alias("tags")), past)
    target = M.Annotations(b.filter("toxic = 0").select(*mark(F.col("id"), F.col("status"), F.when(n % 3 > 0, "note a"))), b.filter("quality = 1").select("id", some(F.lit(True), "good").alias("tags")), past.drop("history_pk").limit(0))
    ids = b.filter(~F.col("id").endswith("7")).select(old.alias("source_id"), F.col("id").alias("target_id"))
    for _ in range(times):
        target, counts = M.merge_annotations(target, source, ids, "src", 1_800_000_000)
        target = M.Annotations(written(target.marks), written(target.tags), written(target.history))
    return target, counts


@query("m3_annotation_marks", f"""WITH {BOTH} SELECT id, CASE WHEN t THEN status ELSE s END AS status, CASE WHEN NOT t THEN 'note b' WHEN ends_with(id, '7') THEN note ELSE concat_ws(chr(10), note, '[병합 src s' || id || '] note b') END AS note FROM b WHERE t OR NOT ends_with(id, '7')""")
def m3_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged twice, which adds nothing."""
    return _merged(spark, sf_dir)[0].marks.select("id", "status", "note")


@query("m3_annotation_tags", f"""WITH {BOTH} SELECT id, CASE WHEN ends_with(id, '7') THEN had ELSE list_sort(list_distinct(list_concat(had, tags))) END AS tags FROM b WHERE len(had) > 0 OR (len(tags) > 0 AND NOT ends_with(id, '7'))""")
def m3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].tags


@query("m3_annotation_history", f"""WITH {BOTH} SELECT id, 'mark' AS action, 50::BIGINT AS changed_unix, NULL AS old_status, status AS new_status, 'merged-history from src record s' || id || ' history_pk ' || k::VARCHAR || CASE WHEN k = 1 THEN chr(10) || 'original detail: why' ELSE '' END AS copied FROM m, (VALUES (1), (2)) v(k) WHERE n % 5 = 0
UNION ALL SELECT id, CASE WHEN t THEN 'merge-skipped' ELSE 'merge' END, 1800000000, CASE WHEN t THEN status END, CASE WHEN t THEN status ELSE s END, NULL FROM m""")
def m3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _merged(spark, sf_dir)[0].history
    return h.select("id", "action", "changed_unix", "old_status", "new_status", F.when(F.col("action") == "mark", F.col("detail")).alias("copied"))


@query("m3_annotation_counts", f"""WITH {BOTH} SELECT count(*) FILTER (NOT t) AS marks_merged, count(*) FILTER (t) AS marks_conflicted, count(*) FILTER (t) AS notes_appended, count(*) FILTER (len(united) > len(had)) AS tags_merged, 2 * count(*) FILTER (n % 5 = 0) AS history_rows_copied,
  (SELECT count(*) FROM b WHERE ends_with(id, '7')) AS annotations_unmapped FROM m""")
def m3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, times=1)[1]


PATCH = f"""{V.MARKS}, st AS (SELECT id, status, 'n' AS note, 3 AS revision, 'c1' AS client_id FROM marks), p AS (SELECT id, CASE WHEN quality = 1 THEN 3 ELSE 2 END AS base, CASE WHEN ends_with(id, '4') THEN 'c1' ELSE 'c2' END AS client, ends_with(id, '8') AS del, CASE WHEN ends_with(id, '3') THEN NULL ELSE 'noted' END AS ns FROM marks),
j AS (SELECT st.*, p.*, base <> revision AND client <> client_id AS conflict, CASE WHEN del THEN false ELSE coalesce(ns, status) = status END AS same FROM st JOIN p ON st.id = p.id)"""


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    labels = V.table(spark, sf_dir, "labels").select(V.record_id(F.col("doc_id")).alias("id"), "quality")
    state = V.marks(spark, sf_dir).select("id", "status", F.lit("n").alias("note"), F.lit(3).cast("long").alias("revision"), F.lit("c1").alias("client_id"), F.lit(False).alias("deleted"))
    i = F.col("id")
    patch = labels.select("id", F.when(F.col("quality") == 1, 3).otherwise(2).cast("long").alias("base_revision"), F.when(i.endswith("4"), "c1").otherwise("c2").alias("client_id"), i.endswith("8").alias("delete"), F.when(~i.endswith("3"), "noted").alias("status"), F.lit(None).cast("string").alias("note"))
    return M.apply_patch(state, patch)


@query("m4_apply_patch", f"""WITH {PATCH} SELECT id, CASE WHEN conflict OR same THEN status WHEN del THEN NULL ELSE coalesce(ns, status) END AS status, CASE WHEN NOT conflict AND NOT same AND del THEN NULL ELSE note END AS note,
  CASE WHEN conflict OR same THEN 3::BIGINT ELSE 4::BIGINT END AS revision, CASE WHEN conflict OR same THEN client_id ELSE client END AS client_id, NOT conflict AND NOT same AND del AS deleted FROM j""")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patched(spark, sf_dir)[0]


@query("m4_conflicts", f"WITH {PATCH} SELECT id, base::BIGINT AS base_revision, 3::BIGINT AS revision FROM j WHERE conflict")
def m4b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patched(spark, sf_dir)[1]


@query("m5_annotation_history", f"WITH {PATCH} SELECT id, status AS old_status, CASE WHEN del THEN NULL ELSE coalesce(ns, status) END AS new_status, 1800000000::BIGINT AS changed_unix FROM j WHERE NOT conflict AND NOT same AND status IS DISTINCT FROM CASE WHEN del THEN NULL ELSE coalesce(ns, status) END")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.annotation_history(V.marks(spark, sf_dir), _patched(spark, sf_dir)[0], 1_800_000_000)


@query("a20_source_registry", """WITH r AS (SELECT o_orderkey AS seq, 'clerk' || (o_custkey % 3)::VARCHAR AS kind, '/dev/' || o_custkey::VARCHAR AS path, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS custodian, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS note, o_orderkey % 4 = 0 AS auto FROM orders)
SELECT 'src_' || substr(sha256(kind || chr(0) || path), 1, 16) AS source_id, kind, path, arg_max(custodian, seq) FILTER (custodian IS NOT NULL) AS custodian,
  coalesce(arg_max(note, seq) FILTER (note IS NOT NULL AND NOT auto), arg_max(note, seq) FILTER (note IS NOT NULL AND auto)) AS note FROM r GROUP BY kind, path""")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_registry(_registrations(spark, sf_dir))[0].drop("hash")


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("seq"), F.concat(F.lit("clerk"), (F.col("o_custkey") % 3).cast("string")).alias("kind"), F.concat(F.lit("/dev/"), F.col("o_custkey").cast("string")).alias("path"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("custodian"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("note"), (k % 4 == 0).alias("auto_note"), F.when(k % 5 == 0, F.sha2(k.cast("string"), 256)).alias("hash"), F.lit("sha256").alias("algorithm"), (k % 10 == 0).alias("computed"))


@query("a20_source_changes", """WITH r AS (SELECT o_orderkey AS seq, 'src_' || substr(sha256('clerk' || (o_custkey % 3)::VARCHAR || chr(0) || '/dev/' || o_custkey::VARCHAR), 1, 16) AS source_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS custodian,
  CASE WHEN o_orderkey % 4 = 2 THEN o_orderstatus END AS own, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS auto, CASE WHEN o_orderkey % 10 = 0 THEN sha256(o_orderkey::VARCHAR) END AS computed, CASE WHEN o_orderkey % 10 = 5 THEN sha256(o_orderkey::VARCHAR) END AS declared FROM orders),
h AS (SELECT seq, source_id, last_value(custodian IGNORE NULLS) OVER w AS custodian, coalesce(last_value(own IGNORE NULLS) OVER w, last_value(auto IGNORE NULLS) OVER w) AS note, coalesce(last_value(computed IGNORE NULLS) OVER w, last_value(declared IGNORE NULLS) OVER w) AS hash
  FROM r WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT seq, source_id, 'custodian' AS field, lag(custodian) OVER v AS was, custodian AS now FROM h WINDOW v AS (PARTITION BY source_id ORDER BY seq)
UNION ALL SELECT seq, source_id, 'note', lag(note) OVER v, note FROM h WINDOW v AS (PARTITION BY source_id ORDER BY seq) UNION ALL SELECT seq, source_id, 'hash', lag(hash) OVER v, hash FROM h WINDOW v AS (PARTITION BY source_id ORDER BY seq))
SELECT * FROM c WHERE was IS NOT NULL AND was <> now""")
def a20_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_registry(_registrations(spark, sf_dir))[1]


@query("u1_timeline", f"""WITH {V.CATALOG}, {V.ENTRIES} SELECT modified_unix AS ts_unix, 'index' AS source, 'file-modified' AS kind, source_path AS path, 'indexed video ' || id || ' filesystem mtime' AS detail, true AS time_unaudited, false AS time_self_consistent FROM catalog WHERE modified_unix > 0
UNION ALL SELECT 1704067200 + doc_id, 'index', 'file-marked-stale', source_path, 'indexed video ' || id || ' marked stale by rescan', true, false FROM catalog WHERE doc_id % 9 = 0
UNION ALL SELECT 1704067200 + doc_id * 60, 'ffprobe', 'media-creation-time', source_path, 'indexed video ' || id || ' ffprobe format creation_time ' || strftime(make_timestamp((1704067200 + doc_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN doc_id % 2 = 0 THEN ' (zone assumed UTC)' ELSE 'Z (zone not verified)' END, true, false FROM catalog WHERE doc_id % 4 = 0
UNION ALL SELECT 1704067200 + doc_id, 'carve', CASE WHEN doc_id % 6 = 0 THEN 'carved-candidate' ELSE 'audit-entry-unauthenticated' END, source_path, 'ftyp', doc_id % 6 <> 0, doc_id % 12 = 0 FROM catalog WHERE doc_id % 3 = 0 AND doc_id % 5 > 0
UNION ALL SELECT ts, 'audit-log', CASE WHEN usable THEN 'audit-event' ELSE 'audit-entry-unauthenticated' END, id, 'audit event ''' || event || ''' recorded in ' || lane::VARCHAR, NOT usable, usable AND line_no % 2 = 0 FROM entries""")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = V.catalog(spark, sf_dir), F.col("doc_id")
    stamp = F.concat(F.date_format(F.timestamp_seconds(1_704_067_200 + n * 60), "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 2 == 1, "Z").otherwise(""))
    c = c.withColumns({"stale": n % 9 == 0, "stale_since": 1_704_067_200 + n, "creation": F.when(n % 4 == 0, stamp)})
    trust = lambda usable, own: F.when(~usable, "not-authenticated").when(own, "self-consistent").otherwise("authenticated")
    carve = c.filter("doc_id % 3 = 0").select(F.col("source_path").alias("path"), F.when(n % 5 > 0, 1_704_067_200 + n).alias("ts"), F.lit("ftyp").alias("signature"), trust(n % 6 == 0, n % 12 == 0).alias("trust"))
    lanes = V.log_entries(spark, sf_dir).select(F.col("lane").cast("string").alias("lane"), "ts", "event", F.col("id").alias("path"), trust(F.col("usable"), F.col("line_no") % 2 == 0).alias("trust"))
    return M.in_time_order(M.timeline(c, carve, lanes)[0])


@query("u3_reproducible", f"WITH {V.CASES}, a AS (SELECT id, source_path, sha256 FROM case_a), b AS (SELECT id, source_path, sha256 FROM case_b), x AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), y AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT x.n AS only_a, y.n AS only_b, x.n = 0 AND y.n = 0 AS reproducible FROM x, y")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (df.select("id", "source_path", "sha256", F.lit(1).alias("stale_since")) for df in V.cases(spark, sf_dir))
    return M.reproducible(a, b)


@query("u4_tag_union", f"WITH {V.MARKS}, t AS (SELECT id, 'good' AS tag FROM marks WHERE quality = 1 UNION SELECT id, 'flag' FROM marks WHERE toxic = 1 UNION SELECT id, status FROM marks) SELECT id, list_sort(list(DISTINCT tag)) AS tags FROM t GROUP BY id")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tag_union(V.tags(spark, sf_dir), V.marks(spark, sf_dir).select("id", F.array("status").alias("tags")))
