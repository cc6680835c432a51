"""Queries that link catalogs, lists, logs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkage as L
from ..operators import triage as T
from . import views as V
from .registry import query


@query("j1_known_hash_split", f"""WITH {V.CATALOG}, {V.KNOWN}
SELECT c.id, CASE WHEN c.sha256 IS NULL THEN 'unhashed' WHEN k.sha256 IS NOT NULL THEN 'known' ELSE 'unknown' END AS hash_class
FROM catalog c LEFT JOIN known k ON c.sha256 = k.sha256""")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.known_hash_split(V.catalog(spark, sf_dir), V.known_hashes(spark, sf_dir)).select("id", "hash_class")


@query("j2_compare_catalogs", f"""WITH {V.CASES},
ra AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY source_path, id) AS rn FROM case_a WHERE sha256 IS NOT NULL),
rb AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY source_path, id) AS rn FROM case_b WHERE sha256 IS NOT NULL),
m AS (SELECT ra.id AS a_id, rb.id AS b_id FROM ra JOIN rb USING (sha256, rn)),
la AS (SELECT * FROM case_a WHERE id NOT IN (SELECT a_id FROM m)), lb AS (SELECT * FROM case_b WHERE id NOT IN (SELECT b_id FROM m)),
p AS (SELECT la.id AS a_id, lb.id AS b_id, CASE WHEN la.sha256 IS NOT NULL AND lb.sha256 IS NOT NULL THEN 'hash_mismatch_same_path' WHEN la.size_bytes IS NOT DISTINCT FROM lb.size_bytes THEN 'both' END AS relation
      FROM la JOIN lb USING (source_path)), q AS (SELECT * FROM p WHERE relation IS NOT NULL)
SELECT 'both' AS relation, a_id, b_id, 'sha256' AS basis FROM m UNION ALL SELECT relation, a_id, b_id, 'path' FROM q
UNION ALL SELECT 'only_a', id, NULL, NULL FROM la WHERE id NOT IN (SELECT a_id FROM q) UNION ALL SELECT 'only_b', NULL, id, NULL FROM lb WHERE id NOT IN (SELECT b_id FROM q)""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compare_catalogs(*V.cases(spark, sf_dir))


@query("j3_accuracy", f"""WITH {V.CASES}, j AS (SELECT a.source_path AS e, b.source_path AS i, a.sha256 AS want, b.sha256 AS have FROM case_a a FULL JOIN case_b b ON a.source_path = b.source_path),
c AS (SELECT count(*) FILTER (e IS NOT NULL AND i IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (i IS NULL) AS fn, count(*) FILTER (want <> have) AS hash_mismatch FROM j),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c)
SELECT *, "precision" >= 0.98 AND recall >= 0.98 AND hash_mismatch = 0 AS passed FROM r""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.accuracy(*V.cases(spark, sf_dir))


@query("j4_consistency", f"""WITH {V.CASES}, j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS l, b.id AS r, a.source_path AS lp, b.source_path AS rp, a.sha256 AS lh, b.sha256 AS rh FROM case_a a FULL JOIN case_b b ON a.id = b.id)
SELECT id, 'left-only' AS issue, lp AS left_value, NULL AS right_value FROM j WHERE r IS NULL UNION ALL SELECT id, 'right-only', NULL, rp FROM j WHERE l IS NULL
UNION ALL SELECT id, 'source_path', lp, rp FROM j WHERE l IS NOT NULL AND r IS NOT NULL AND lp <> rp UNION ALL SELECT id, 'sha256', lh, rh FROM j WHERE lh <> rh""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.consistency(*V.cases(spark, sf_dir))


@query("j5_verify_manifest", f"""WITH {V.PACKAGE}, m AS (SELECT path, count(*) AS n, min(sha256) AS h, min(size_bytes) AS s FROM manifest GROUP BY path),
j AS (SELECT coalesce(m.path, f.path) AS path, m.path AS mp, f.path AS fp, n, h, s, f.sha256 AS fh, f.size_bytes AS fs FROM m FULL JOIN files f ON m.path = f.path)
SELECT path, 'missing' AS problem FROM j WHERE fp IS NULL UNION ALL SELECT path, 'hash-mismatch' FROM j WHERE h <> fh UNION ALL SELECT path, 'size-mismatch' FROM j WHERE s <> fs
UNION ALL SELECT path, 'duplicate-entry' FROM j WHERE n > 1 UNION ALL SELECT path, 'unlisted' FROM j WHERE mp IS NULL""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.verify_manifest(*V.package(spark, sf_dir))


def _rescan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = V.cases(spark, sf_dir)
    fit = lambda df: df.withColumns({"path_key": F.col("source_path"), "stale": F.lit(False), "probe_ok": F.lit(True)})
    now = b.withColumn("modified_unix", F.when(F.col("doc_id") % 9 == 0, F.col("modified_unix") + 1).otherwise(F.col("modified_unix")))
    return fit(a), fit(now)


@query("j6_rescan_diff", f"""WITH {V.CASES}, now AS (SELECT * REPLACE (CASE WHEN doc_id % 9 = 0 THEN modified_unix + 1 ELSE modified_unix END AS modified_unix) FROM case_b)
SELECT coalesce(o.source_path, n.source_path) AS path_key, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'absent'
  WHEN o.size_bytes = n.size_bytes AND o.modified_unix = n.modified_unix AND o.sha256 IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS change
FROM case_a o FULL JOIN now n ON o.source_path = n.source_path""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rescan_diff(*_rescan(spark, sf_dir), need_hash=True)


@query("j7_carry_facts", f"""WITH {V.CASES}, o AS (SELECT DISTINCT source_path, size_bytes, modified_unix, sha256, CASE WHEN doc_id % 5 = 0 THEN 'failed' END AS hs FROM case_a), s AS (SELECT source_path, size_bytes, modified_unix, CASE WHEN doc_id % 2 = 0 THEN sha256(source_path) END AS sha256 FROM case_a WHERE doc_id % 3 = 0)
SELECT n.source_path AS path_key, n.size_bytes, n.modified_unix, coalesce(s.sha256, o.sha256) AS sha256, CASE WHEN s.sha256 IS NOT NULL THEN 'salvaged' WHEN o.sha256 IS NOT NULL THEN 'hashed' WHEN o.hs = 'failed' THEN 'failed' ELSE 'not-computed' END AS hash_status,
  CASE WHEN s.source_path IS NOT NULL THEN false WHEN o.source_path IS NOT NULL AND n.doc_id % 4 = 0 THEN true END AS probe_ok
FROM case_b n LEFT JOIN o ON n.source_path = o.source_path AND n.size_bytes = o.size_bytes AND n.modified_unix = o.modified_unix LEFT JOIN s ON n.source_path = s.source_path AND n.size_bytes = s.size_bytes AND n.modified_unix = s.modified_unix""")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = V.cases(spark, sf_dir)
    n = F.col("doc_id")
    old = old.withColumns({"path_key": F.col("source_path"), "hash_status": F.when(n % 5 == 0, "failed"), "probe_ok": F.when(n % 4 == 0, True)})
    other = F.when(n % 2 == 0, F.sha2("source_path", 256))
    salvaged = old.filter("doc_id % 3 = 0").withColumns({"sha256": other, "hash_status": F.when(other.isNotNull(), "salvaged"), "probe_ok": F.lit(False)})
    return L.carry_facts(now.withColumn("path_key", F.col("source_path")), salvaged, old, hashing=False, probing=False)


@query("j8_merge_catalog", f"""WITH {V.CASES}, o AS (SELECT a.* REPLACE ('vid_' || (999950 + doc_id + CASE WHEN doc_id % 4 = 0 THEN 50 ELSE 0 END)::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'newer' ELSE sha256 END AS sha256), doc_id % 3 AS st FROM case_a a)
SELECT source_path AS path_key, id, source_path, size_bytes, modified_unix, sha256, false AS stale, NULL::BIGINT AS stale_since FROM case_b
UNION ALL SELECT source_path, id, source_path, size_bytes, modified_unix, sha256, st = 0, CASE WHEN st = 0 THEN 1800000000 END FROM o WHERE source_path NOT IN (SELECT source_path FROM case_b)""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth old path has two rows, the later with an id fifty on: many of seven digits against six."""
    a, b = V.cases(spark, sf_dir)
    n = F.col("doc_id")
    numbered = lambda more: F.format_string("vid_%06d", n + (999_950 + more))
    old = a.withColumn("id", numbered(0)).unionByName(a.filter(n % 4 == 0).withColumns({"id": numbered(50), "sha256": F.lit("newer")}))
    old = old.withColumns({"path_key": F.col("source_path"), "stale": F.lit(False), "stale_since": F.lit(None).cast("long")})
    state = F.element_at(F.array(F.lit("missing"), F.lit("present"), F.lit("error")), (n % 3 + 1).cast("int"))
    return L.merge_catalog(old, b.withColumn("path_key", F.col("source_path")), old.select("path_key", state.alias("state")).distinct(), 1_800_000_000)


@query("j9_live_overlay", f"""WITH {V.CASES}, b AS (SELECT doc_id AS ord, id, source_path, sha256 FROM case_a), l AS (SELECT doc_id AS line_no, CASE WHEN (doc_id + 1) % 10 = 7 THEN id || 'x' ELSE id END AS id, source_path, sha256 FROM case_b),
x AS (SELECT b.ord, b.id AS bid, b.source_path AS bp, b.sha256 AS bh, i.id AS iid, i.source_path AS ip, i.sha256 AS ih, p.id AS pid, p.source_path AS pp, p.sha256 AS ph
      FROM b LEFT JOIN l i ON b.id = i.id LEFT JOIN (SELECT * FROM l WHERE id NOT IN (SELECT id FROM b)) p ON b.source_path = p.source_path)
SELECT ord, coalesce(iid, pid, bid) AS id, coalesce(ip, pp, bp) AS source_path, CASE WHEN iid IS NOT NULL THEN ih WHEN pid IS NOT NULL THEN ph ELSE bh END AS sha256 FROM x
UNION ALL SELECT (SELECT max(ord) FROM b) + line_no, id, source_path, sha256 FROM l WHERE id NOT IN (SELECT id FROM b) AND id NOT IN (SELECT pid FROM x WHERE pid IS NOT NULL AND iid IS NULL)""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    new_id = F.when((F.col("doc_id") + 1) % 10 == 7, F.concat("id", F.lit("x"))).otherwise(F.col("id"))
    return L.live_overlay(a.select(F.col("doc_id").alias("ord"), "id", "source_path", "sha256"), b.select(F.col("doc_id").alias("line_no"), new_id.alias("id"), "source_path", "sha256"))


@query("j10_channel_mates", """WITH k AS (SELECT event_id AS id, event_id // 4 AS pair_key, ['F', 'R', 'R', NULL][(event_id % 4 + 1)::INTEGER] AS channel FROM events)
SELECT a.id, b.id AS mate_id FROM k a JOIN k b USING (pair_key) WHERE a.id <> b.id AND a.channel <> b.channel""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.paths import channel_code, pair_key

    n = F.col("event_id")
    side = F.element_at(F.array(*map(F.lit, ("_F", "_R", "-rear", ""))), (n % 4 + 1).cast("int"))
    clip = F.expr("cast(event_id div 4 as string)")
    path = F.concat(F.lit("/cam/clip"), clip, side, F.lit(".mp4"))
    c = V.table(spark, sf_dir, "events").select(n.alias("id"), path.alias("path"))
    return L.channel_mates(c.select("id", pair_key(F.col("path")).alias("pair_key"), channel_code(F.col("path")).alias("channel")))


@query("j11_record_status", f"""WITH {V.CATALOG}, {V.ENTRIES}, v AS (SELECT printf('vid_%06d', lane + 1) AS id, line_no, usable, is_repair FROM entries),
n AS (SELECT id, max_by(usable, line_no) AS usable, max_by(is_repair, line_no) AS rep FROM v GROUP BY id)
SELECT c.id, CASE WHEN n.id IS NULL THEN 'extension-candidate' WHEN NOT usable THEN 'unconfirmed' WHEN rep THEN 'unconfirmed' ELSE 'confirmed' END AS status FROM catalog c LEFT JOIN n ON c.id = n.id""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    e = V.log_entries(spark, sf_dir).withColumn("rid", V.record_id(F.col("lane")))
    v = e.join(c.select(F.col("id").alias("rid"), "source_path"), "rid").select(F.col("source_path").alias("path"), "line_no", F.lit("confirmed").alias("status"), "usable", (~F.col("is_repair")).alias("after_repair"), F.lit(False).alias("revalidated"))
    return L.record_status(c.withColumn("status", F.lit(None).cast("string")), v)


@query("j13_pending_work", f"""WITH {V.CASES} SELECT a.id FROM case_a a WHERE NOT EXISTS (SELECT 1 FROM case_b b WHERE b.id = a.id AND b.source_path = a.source_path AND b.doc_id % 4 <> 0)""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    return L.pending_work(a, b.withColumn("status", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("done")), retry_failed=True).select("id")


@query("j14_measurement_state", f"""WITH {V.CASES} SELECT a.id, CASE WHEN b.id IS NULL THEN 'none'
  WHEN a.size_bytes IS DISTINCT FROM b.size_bytes OR a.modified_unix IS DISTINCT FROM b.modified_unix OR coalesce(a.sha256 <> b.sha256, false) THEN 'stale' WHEN a.doc_id % 2 = 0 THEN 'unverified' ELSE 'current' END AS state
FROM case_a a LEFT JOIN case_b b ON a.id = b.id""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    return L.measurement_state(a, b.withColumn("verified", F.col("doc_id") % 2 == 1))


@query("j21_bound_hashes", f"""WITH {V.CASES}, s AS (SELECT id, sha256, doc_id AS line_no, 0 AS k FROM case_a WHERE doc_id % 8 <> 0 UNION ALL SELECT id, sha256, doc_id, 1 FROM case_b WHERE doc_id % 3 <> 0)
SELECT id, max_by(sha256, k) AS sha256 FROM s WHERE sha256 IS NOT NULL GROUP BY id""")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    line = lambda df, m: df.select("id", "sha256", F.col("doc_id").alias("line_no"), (F.col("doc_id") % m != 0).alias("usable"))
    return L.bound_hashes([line(a, 8), line(b, 3)])


@query("j22_link_derivatives", f"""WITH {V.CATALOG}, f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'proxy_' || id || '_' || substr(sha256, 1, 8) || '.mp4' WHEN 1 THEN 'thumbnail_' || id || '.jpg' ELSE 'proxy_' || id || '_00000000.mp4' END AS file, doc_id, id, sha256 FROM catalog WHERE sha256 IS NOT NULL)
SELECT file, CASE doc_id % 3 WHEN 1 THEN 'thumbnail' ELSE 'proxy' END AS kind, id, CASE doc_id % 3 WHEN 0 THEN 'exact' ELSE 'legacy' END AS match FROM f WHERE doc_id % 3 < 2""")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("proxy_"), "id", F.lit("_"), F.substring("sha256", 1, 8), F.lit(".mp4"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("thumbnail_"), "id", F.lit(".jpg"))).otherwise(F.concat(F.lit("proxy_"), "id", F.lit("_00000000.mp4")))
    return L.link_derivatives(c, c.filter("sha256 is not null").select(name.alias("file")))


@query("j23_recovered_origin", f"""WITH {V.CATALOG}, l AS (SELECT doc_id::VARCHAR AS inode, source_path AS path, doc_id % 2 = 0 AS deleted, extension <> 'ts' AS v, doc_id FROM catalog)
SELECT inode, path AS original_path, 'recovered' AS record_kind FROM l WHERE doc_id % 6 = 0 UNION ALL SELECT inode, path, 'candidate' FROM l WHERE deleted AND v AND doc_id % 6 <> 0""")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    listing = c.select(F.col("doc_id").cast("string").alias("inode"), F.col("source_path").alias("path"), (F.col("doc_id") % 2 == 0).alias("deleted"), (F.col("extension") != "ts").alias("video_candidate"))
    return L.recovered_origin(c.filter("doc_id % 6 = 0").select(F.col("doc_id").cast("string").alias("inode")), listing)


@query("j25_resolve_selection", f"""WITH {V.CATALOG}, g AS (SELECT id, 'out/' || source || '/' || (doc_id % 50)::VARCHAR || '.mp4' AS output_path, doc_id % 5 <> 0 AS usable, doc_id FROM catalog), s AS (SELECT id AS selector FROM catalog WHERE doc_id % 4 = 0)
SELECT DISTINCT s.selector, g.output_path, g.output_path IS NOT NULL AS matched FROM s LEFT JOIN g ON g.usable AND s.selector = g.id""")
def j25(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir)
    logs = c.select("id", F.lit(None).cast("string").alias("inode"), F.col("id").alias("selector"), F.concat(F.lit("out/"), "source", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".mp4")).alias("output_path"), "source_path", (F.col("doc_id") % 5 != 0).alias("usable"))
    return L.resolve_selection(c.filter("doc_id % 4 = 0").select(F.col("id").alias("selector"), F.lit(None).cast("string").alias("path")), logs)


@query("j26_binding_drift", f"""WITH {V.CASES} SELECT a.id, CASE WHEN b.sha256 IS NULL THEN 'unavailable' WHEN a.sha256 = b.sha256 THEN 'current' ELSE 'changed' END AS drift FROM case_a a LEFT JOIN case_b b ON a.id = b.id WHERE a.sha256 IS NOT NULL""")
def j26(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    return L.binding_drift(a.filter("sha256 is not null"), b)


@query("j26_binding_report", f"""WITH {V.CATALOG}, {V.MARKS}, c AS (SELECT *, regexp_extract(source, '[0-9]+')::BIGINT AS n FROM catalog),
s AS (SELECT source AS case_id, n, bool_or(sha256 IS NOT NULL) AS bound, bool_or(sha256 IS NOT NULL AND n % 3 = 2 AND doc_id % 10 = 5) AS ch, bool_or(sha256 IS NOT NULL AND n % 3 = 1 AND doc_id % 10 = 0) AS mi, bool_or(id IN (SELECT id FROM marks)) AS mk FROM c GROUP BY source, n),
p AS (SELECT case_id, CASE WHEN ch THEN 'changed' WHEN mi THEN 'partially-verified' WHEN bound THEN 'current' END AS evidence, CASE WHEN NOT mk THEN NULL WHEN n % 5 = 1 THEN 'changed' WHEN n % 5 = 2 THEN 'partially-verified' ELSE 'current' END AS marks,
  CASE n % 7 WHEN 3 THEN 'changed' WHEN 4 THEN 'partially-verified' ELSE 'current' END AS lanes FROM s)
SELECT *, CASE WHEN list_contains([evidence, marks, lanes], 'changed') THEN 'changed' WHEN list_contains([evidence, marks, lanes], 'partially-verified') THEN 'partially-verified' ELSE 'current' END AS state FROM p""")
def j26b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are sources: by their number some evidence changed or is gone, a mark changed or marks can't be read, a lane was cut or is missing."""
    n = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    c = V.catalog(spark, sf_dir).withColumn("n", n)
    bound = c.filter("sha256 is not null")
    now = bound.filter("not (n % 3 = 1 and doc_id % 10 = 0)").withColumn("sha256", F.when((F.col("n") % 3 == 2) & (F.col("doc_id") % 10 == 5), F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    drift = L.binding_drift(bound, now).join(c.select("id", F.col("source").alias("case_id")), "id")
    marked = V.marks(spark, sf_dir).join(c.select("id", "source", "n"), "id")
    line = lambda status: marked.select("source", "n", F.concat_ws(":", "id", status).alias("mark"))
    digest = lambda df, name: T.set_fingerprint(df, "source", "mark").select(F.col("source").alias("case_id"), F.col("digest").alias(name))
    later = line(F.when(F.col("n") % 5 == 1, F.concat("status", F.lit("!"))).otherwise(F.col("status"))).filter("n % 5 <> 2")
    marks = digest(line(F.col("status")), "bound").join(digest(later, "now"), "case_id", "left")
    lanes = c.select(F.col("source").alias("case_id"), F.when(F.col("n") % 7 == 3, "truncated").when(F.col("n") % 7 == 4, "missing").otherwise("intact").alias("state")).distinct()
    return L.binding_report(drift, marks, lanes)


@query("j27_index_listing", f"""WITH {V.CASES} SELECT l.source_path AS path_key, l.size_bytes + CASE WHEN l.doc_id % 12 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN c.id IS NOT NULL AND l.doc_id % 12 <> 0 THEN c.id END AS id,
  CASE WHEN c.id IS NOT NULL AND l.doc_id % 12 <> 0 THEN 'hashed' ELSE 'not-computed' END AS hash_status, c.id IS NOT NULL AND l.doc_id % 12 <> 0 AS kept
FROM case_b l LEFT JOIN case_a c ON l.source_path = c.source_path WHERE l.doc_id % 5 <> 0""")
def j27(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    listing = b.select(F.col("source_path").alias("path_key"), (F.col("size_bytes") + F.when(F.col("doc_id") % 12 == 0, 1).otherwise(0)).alias("size_bytes"), F.lit(True).alias("video_candidate"), (F.col("doc_id") % 5 == 0).alias("deleted"))
    return L.index_listing(listing, a.withColumns({"path_key": F.col("source_path"), "hash_status": F.lit("hashed")}))


@query("j28_required_artifacts", f"""WITH {V.CATALOG} SELECT source AS case_id, 'reports/' || (doc_id % 97)::VARCHAR AS path FROM catalog EXCEPT SELECT source, 'reports/' || (doc_id % 97)::VARCHAR FROM catalog WHERE doc_id % 3 = 0""")
def j28(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.catalog(spark, sf_dir).select(F.col("source").alias("case_id"), F.concat(F.lit("reports/"), (F.col("doc_id") % 97).cast("string")).alias("path"), "doc_id")
    return L.required_artifacts(c.select("case_id", "path").distinct(), c.filter("doc_id % 3 = 0"))


@query("a17_rehash_check", f"""WITH {V.CASES} SELECT a.id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.doc_id % 13 = 0 THEN 'unreadable' WHEN a.sha256 IS NULL THEN 'no-recorded-hash' WHEN a.sha256 = b.sha256 THEN 'match' ELSE 'mismatch' END AS result FROM case_a a LEFT JOIN case_b b ON a.id = b.id""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.cases(spark, sf_dir)
    return L.rehash_check(a, b.withColumn("readable", F.col("doc_id") % 13 != 0))
