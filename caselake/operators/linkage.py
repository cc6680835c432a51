"""Linking catalogs to each other and to lists: hashes, manifests, logs, derivatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import long_keys, parted
from .sequence import record_number

def clean_hash(c: Column) -> Column:
    """The hash in lower case; null for an empty one."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def known_hash_split(catalog: DataFrame, hashes: DataFrame, hash_col: str = "sha256") -> DataFrame:
    """`catalog` with `hash_class`: known, unknown, or unhashed (neither match nor mismatch)."""
    listed = hashes.select(clean_hash(F.col(hash_col)).alias("_known")).filter("_known is not null").distinct()
    own = clean_hash(catalog[hash_col])
    out = catalog.join(listed, own == F.col("_known"), "left")
    return out.withColumn("hash_class", F.when(own.isNull(), "unhashed").when(F.col("_known").isNotNull(), "known").otherwise("unknown")).drop("_known")


def compare_catalogs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-to-one matches of two catalogs (id, source_path, sha256, size_bytes).

    Rows of equal content pair first, in order of path and id. Of the rest, rows of equal
    path: with two different hashes they are a mismatch, with a hash missing they pair if
    their sizes agree. Output: relation (both, hash_mismatch_same_path, only_a, only_b),
    a_id, b_id, basis (sha256, path).
    """

    def ranked(df: DataFrame, p: str) -> DataFrame:
        """Columns p_id ... with the rank among rows of equal content; an unhashed row is alone, so that these are no hot group."""
        d = df.select("id", "source_path", "size_bytes", clean_hash(F.col("sha256")).alias("sha"))
        alone = F.coalesce("sha", F.concat(F.lit("\0"), "id"))
        d = d.withColumn("rn", F.row_number().over(Window.partitionBy(alone).orderBy("source_path", "id")))
        return d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])

    by_hash = ranked(a, "a").join(ranked(b, "b"), (F.col("a_sha") == F.col("b_sha")) & (F.col("a_rn") == F.col("b_rn")), "full_outer")
    matched = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    both = by_hash.filter(matched).select(F.lit("both").alias("relation"), "a_id", "b_id", F.lit("sha256").alias("basis"))

    fields = ("id", "source_path", "size_bytes", "sha")
    row = lambda p: F.struct(*[F.col(f"{p}_{f}").alias(f) for f in fields])
    rest = by_hash.filter(~matched).select(F.col("a_id").isNotNull().alias("is_a"), F.when(F.col("a_id").isNotNull(), row("a")).otherwise(row("b")).alias("r"))
    rest = rest.withColumn("rn", F.row_number().over(Window.partitionBy("is_a", "r.source_path").orderBy("r.id")))
    pair = rest.groupBy("r.source_path", "rn").agg(F.max(F.when(F.col("is_a"), F.col("r"))).alias("a"), F.max(F.when(~F.col("is_a"), F.col("r"))).alias("b"))
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    mismatch = here & F.col("a.sha").isNotNull() & F.col("b.sha").isNotNull()
    same = here & ~mismatch & F.col("a.size_bytes").eqNullSafe(F.col("b.size_bytes"))
    out = lambda relation, x, y, basis: F.struct(F.lit(relation).alias("relation"), x.alias("a_id"), y.alias("b_id"), F.lit(basis).cast("string").alias("basis"))
    none = F.lit(None).cast("string")
    x, y = F.col("a.id"), F.col("b.id")
    rows = F.array_compact(F.array(
        F.when(mismatch, out("hash_mismatch_same_path", x, y, "path")),
        F.when(same, out("both", x, y, "path")),
        F.when(F.col("a").isNotNull() & ~mismatch & ~same, out("only_a", x, none, None)),
        F.when(F.col("b").isNotNull() & ~mismatch & ~same, out("only_b", none, y, None)),
    ))
    return both.unionByName(pair.select(F.explode(rows).alias("o")).select("o.*"))


def accuracy(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, hash_mismatch, precision, recall, passed.

    Rows join on the path with slashes; an expected row without a hash asks for the path
    only. An empty denominator counts as 1.0. It takes 0.98 of both and no mismatch to pass.
    """
    norm = F.translate("source_path", "\\", "/")
    e = expected.select(norm.alias("path"), clean_hash(F.col("sha256")).alias("want")).dropDuplicates(["path"])
    i = indexed.select(norm.alias("path"), clean_hash(F.col("sha256")).alias("have")).dropDuplicates(["path"])
    j = e.withColumn("e", F.lit(True)).join(i.withColumn("i", F.lit(True)), "path", "full_outer")
    counts = j.agg(
        F.count_if(F.col("e") & F.col("i")).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"),
        F.count_if(F.col("i").isNull()).alias("fn"),
        F.count_if(F.col("e") & F.col("i") & (F.col("want") != F.col("have"))).alias("hash_mismatch"),
    )
    ratio = lambda of: F.when(F.col("tp") + F.col(of) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(of)))
    counts = counts.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})
    return counts.withColumn("passed", (F.col("precision") >= 0.98) & (F.col("recall") >= 0.98) & (F.col("hash_mismatch") == 0))


def consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two stores of one catalog: id, issue (left-only, right-only, source_path, sha256), left_value, right_value. A hash counts only if both have one."""
    l = left.select("id", F.col("source_path").alias("lp"), clean_hash(F.col("sha256")).alias("lh"), F.lit(1).alias("l"))
    r = right.select("id", F.col("source_path").alias("rp"), clean_hash(F.col("sha256")).alias("rh"), F.lit(1).alias("r"))
    j = l.join(r, "id", "full_outer")
    s = lambda issue, a, b: F.struct(F.lit(issue).alias("issue"), a.alias("left_value"), b.alias("right_value"))
    none = F.lit(None).cast("string")
    issues = F.array_compact(F.array(
        F.when(F.col("r").isNull(), s("left-only", F.col("lp"), none)),
        F.when(F.col("l").isNull(), s("right-only", none, F.col("rp"))),
        F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("lp").eqNullSafe(F.col("rp")), s("source_path", F.col("lp"), F.col("rp"))),
        F.when(F.col("lh") != F.col("rh"), s("sha256", F.col("lh"), F.col("rh"))),
    ))
    return j.select("id", F.explode(issues).alias("i")).select("id", "i.*")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Problems of a package: path, problem (missing, hash-mismatch, size-mismatch, duplicate-entry, unlisted, unsafe-path). No rows: it passes.

    Both tables have path, sha256 and size_bytes; paths are relative.
    """
    m = manifest.groupBy("path").agg(F.count("*").alias("entries"), F.min(clean_hash(F.col("sha256"))).alias("mh"), F.min("size_bytes").alias("ms"))
    f = files.select("path", clean_hash(F.col("sha256")).alias("fh"), F.col("size_bytes").alias("fs"), F.lit(1).alias("there"))
    j = m.join(f, "path", "full_outer")
    unsafe = F.col("path").rlike(r"^([A-Za-z]:|[\\/])|(^|[\\/])\.\.([\\/]|$)")
    listed = F.col("entries").isNotNull()
    problems = F.array_compact(F.array(
        F.when(listed & F.col("there").isNull(), "missing"),
        F.when(F.col("mh") != F.col("fh"), "hash-mismatch"),
        F.when(F.col("ms") != F.col("fs"), "size-mismatch"),
        F.when(F.col("entries") > 1, "duplicate-entry"),
        F.when(~listed, "unlisted"),
        F.when(unsafe, "unsafe-path"),
    ))
    return j.select("path", F.explode(problems).alias("problem"))


def rescan_diff(old: DataFrame, now: DataFrame, need_probe: bool = False, need_hash: bool = False) -> DataFrame:
    """path_key and change (new, unchanged, changed, absent) of a rescan.

    Unchanged: size and mtime are equal and known, the old row is not stale, and it has every
    fact that the run would compute.
    """
    o = old.select("path_key", F.col("size_bytes").alias("os"), F.col("modified_unix").alias("om"), F.coalesce("stale", F.lit(False)).alias("stale"), clean_hash(F.col("sha256")).alias("sha"), F.col("probe_ok"), F.lit(1).alias("o"))
    n = now.select("path_key", F.col("size_bytes").alias("ns"), F.col("modified_unix").alias("nm"), F.lit(1).alias("n"))
    facts = (F.col("sha").isNotNull() if need_hash else F.lit(True)) & (F.col("probe_ok").isNotNull() if need_probe else F.lit(True))
    same = (F.col("os") == F.col("ns")) & (F.col("om") == F.col("nm")) & ~F.col("stale") & facts
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "absent").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return o.join(n, "path_key", "full_outer").select("path_key", change.alias("change"))


def carry_facts(now: DataFrame, salvaged: DataFrame, old: DataFrame, hashing: bool, probing: bool, incremental: bool = False) -> DataFrame:
    """`now` with sha256, hash_status and probe_ok from earlier rows of the same path, size and mtime.

    A salvaged row gives whatever it has. An old row gives only what this pass does not
    compute, unless the pass is incremental; a failed hash stays failed when nothing is hashed.
    """
    def donor(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("path_key"), F.col("size_bytes"), F.col("modified_unix"), *[F.col(c).alias(f"{p}_{c}") for c in ("sha256", "hash_status", "probe_ok")]).dropDuplicates(["path_key", "size_bytes", "modified_unix"])

    on = ["path_key", "size_bytes", "modified_unix"]
    j = now.select("path_key", "size_bytes", "modified_unix").join(donor(salvaged, "s"), on, "left").join(donor(old, "o"), on, "left")
    take_hash, take_probe = F.lit(incremental or not hashing), F.lit(incremental or not probing)
    sha = F.coalesce("s_sha256", F.when(take_hash, F.col("o_sha256")))
    failed = F.when(F.lit(not hashing) & (F.col("o_hash_status") == "failed"), "failed")
    status = F.coalesce(F.col("s_hash_status"), F.when(sha.isNotNull(), "hashed"), failed, F.lit("not-computed"))
    return j.select(*on, sha.alias("sha256"), status.alias("hash_status"), F.coalesce("s_probe_ok", F.when(take_probe, F.col("o_probe_ok"))).alias("probe_ok"))


def merge_catalog(old: DataFrame, now: DataFrame, present: DataFrame, stamp: int) -> DataFrame:
    """The next catalog: rows of `now` replace, other old rows stay.

    `present` has path_key and state (present, missing, error) of old paths that `now` lacks.
    Only a row known to be missing turns stale, at `stamp` unless it was before; an error
    tells nothing. Old rows of one path key become one, the newest id (by its number) winning.
    """
    own = old.columns
    newest = F.max_by(F.struct(*own), F.struct(F.coalesce(record_number(F.col("id")), F.lit(-1).cast("long")), "id"))
    o = old.groupBy(F.col("path_key").alias("_key")).agg(newest.alias("_o")).select("_o.*")
    cols = ["path_key", "id", "source_path", "size_bytes", "modified_unix", "sha256"]
    fresh = now.select(*cols, F.lit(False).alias("stale"), F.lit(None).cast("long").alias("stale_since"))
    rest = o.join(now.select("path_key"), "path_key", "left_anti").join(present.select("path_key", "state"), "path_key", "left")
    gone = F.col("state") == "missing"
    stale = F.when(gone, True).when(F.col("state") == "present", False).otherwise(F.coalesce("stale", F.lit(False)))
    since = F.when(stale, F.coalesce("stale_since", F.when(gone, F.lit(stamp)))).cast("long")
    return fresh.unionByName(rest.select(*cols, stale.alias("stale"), since.alias("stale_since")))


def live_overlay(base: DataFrame, live: DataFrame) -> DataFrame:
    """`base` (ord, id, source_path, ...) with live records (line_no, id, source_path, ...) in place of those of the same id, else of the same path; others follow in line order. Of live lines of one id the last counts."""
    cols = [c for c in base.columns if c not in ("ord",)]
    last = live.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("line_no")))).filter("_rn = 1").drop("_rn")
    renamed = last.select(*[F.col(c).alias(f"_{c}") for c in last.columns])
    by_id = base.join(renamed, F.col("id") == F.col("_id"), "left")
    hit_id = by_id.filter("_id is not null").select("ord", *[F.col(f"_{c}").alias(c) for c in cols])
    left = last.join(hit_id.select("id"), "id", "left_anti")
    path_rn = F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("line_no")))
    left_path = left.withColumn("_rn", path_rn).filter("_rn = 1").select(*[F.col(c).alias(f"_{c}") for c in last.columns])
    base_left = base.join(last.select("id"), "id", "left_anti")
    by_path = base_left.join(left_path, F.col("source_path") == F.col("_source_path"), "left")
    hit_path = by_path.filter("_id is not null").select("ord", *[F.col(f"_{c}").alias(c) for c in cols])
    keep = by_path.filter("_id is null").select("ord", *cols)
    rest = left.join(hit_path.select("id"), "id", "left_anti")
    top = base.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    added = rest.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("line_no")).alias("ord"), *cols)
    return reduce(DataFrame.unionByName, [keep, hit_id, hit_path, added])


def pending_work(catalog: DataFrame, reports: DataFrame, force: bool = False, retry_failed: bool = False) -> DataFrame:
    """Records that still need a report: none yet, one bound to another path (a reused id), with `retry_failed` a failed one, with `force` all."""
    if force:
        return catalog
    done = reports.filter("status <> 'failed'") if retry_failed else reports
    r = done.select(F.col("id").alias("_id"), F.col("source_path").alias("_path")).distinct()
    return catalog.join(r, (catalog["id"] == r["_id"]) & (catalog["source_path"] == r["_path"]), "left_anti")


def measurement_state(catalog: DataFrame, measurements: DataFrame) -> DataFrame:
    """id and state (none, current, stale, unverified): a measurement is current if size and mtime are equal and hashes do not contradict."""
    m = measurements.select(F.col("id").alias("_id"), F.col("size_bytes").alias("_s"), F.col("modified_unix").alias("_m"), clean_hash(F.col("sha256")).alias("_h"), "verified")
    j = catalog.join(m, catalog["id"] == F.col("_id"), "left")
    agree = F.col("size_bytes").eqNullSafe(F.col("_s")) & F.col("modified_unix").eqNullSafe(F.col("_m")) & F.coalesce(clean_hash(F.col("sha256")) == F.col("_h"), F.lit(True))
    return j.select("id", F.when(F.col("_id").isNull(), "none").when(~agree, "stale").when(~F.coalesce("verified", F.lit(False)), "unverified").otherwise("current").alias("state"))


def bound_hashes(stores: list[DataFrame]) -> DataFrame:
    """id and sha256 from several stores (id, sha256, line_no, usable): a later store wins, in a store the last usable line."""
    tagged = [s.filter("usable").select("id", clean_hash(F.col("sha256")).alias("sha256"), F.struct(F.lit(k).alias("store"), F.col("line_no")).alias("at")) for k, s in enumerate(stores)]
    return reduce(DataFrame.unionByName, tagged).filter("sha256 is not null").groupBy("id").agg(F.max_by("sha256", "at").alias("sha256"))


def link_derivatives(records: DataFrame, files: DataFrame) -> DataFrame:
    """file, kind, id, match (exact, legacy): <kind>_<id>_<hash8>.<ext> belongs to the record of that id whose hash starts so; an older name without hash belongs by id."""
    pattern = r"^([a-z]+)_(vid_\d+)(?:_([0-9a-f]{8}))?\.[A-Za-z0-9]+$"
    f = files.select("file", *[F.regexp_extract("file", pattern, k).alias(n) for k, n in ((1, "kind"), (2, "fid"), (3, "hash8"))]).filter("fid <> ''")
    j = f.join(records.select("id", clean_hash(F.col("sha256")).alias("sha")), F.col("fid") == F.col("id"))
    fits = F.when(F.col("hash8") == "", "legacy").when(F.substring("sha", 1, 8) == F.col("hash8"), "exact")
    return j.withColumn("match", fits).filter("match is not null").select("file", "kind", "id", "match")


def recovered_origin(recovered: DataFrame, listing: DataFrame) -> DataFrame:
    """inode, original_path, record_kind: recovered rows with the path their inode had, and deleted video entries of the listing that nothing has recovered."""
    l = listing.select(F.col("inode").alias("_inode"), F.col("path").alias("_path"), "deleted", "video_candidate")
    got = recovered.join(l, F.col("inode") == F.col("_inode"), "left").select("inode", F.col("_path").alias("original_path"), F.lit("recovered").alias("record_kind"))
    rest = l.filter("deleted and video_candidate").join(recovered.select("inode"), F.col("_inode") == F.col("inode"), "left_anti")
    return got.unionByName(rest.select(F.col("_inode").alias("inode"), F.col("_path").alias("original_path"), F.lit("candidate").alias("record_kind")))


def resolve_selection(selection: DataFrame, logs: DataFrame) -> DataFrame:
    """selector, output_path, matched: a selector stands for the id, inode, selector or output path of usable log entries. With a `path` in the selection, an entry's source must agree. Unmatched selectors come back with null."""
    keys = F.explode(F.array_compact(F.array("id", "inode", "selector", "output_path")))
    log = logs.filter("usable").select(keys.alias("_key"), F.col("output_path").alias("_out"), F.col("source_path").alias("_src")).filter("_out is not null")
    j = selection.join(log, (F.col("selector") == F.col("_key")) & (F.col("path").isNull() | (F.col("path") == F.col("_src"))), "left")
    return j.select("selector", F.col("_out").alias("output_path"), F.col("_out").isNotNull().alias("matched")).distinct()


def binding_drift(bound: DataFrame, now: DataFrame) -> DataFrame:
    """id and drift (current, changed, unavailable) of bound hashes (id, sha256) against observed ones."""
    b = bound.select("id", clean_hash(F.col("sha256")).alias("was"))
    n = now.select("id", clean_hash(F.col("sha256")).alias("now"))
    return b.join(n, "id", "left").select("id", F.when(F.col("now").isNull(), "unavailable").when(F.col("was") == F.col("now"), "current").otherwise("changed").alias("drift"))


def binding_report(evidence: DataFrame, marks: DataFrame, lanes: DataFrame) -> DataFrame:
    """case_id, evidence, marks, lanes, state: whether what a case was signed for is still so.

    evidence: case_id, drift (as `binding_drift` has it); marks: case_id, bound, now (digests of
    the set of marks, as `triage.set_fingerprint` gives them; now null: they can't be read); lanes:
    case_id, state (of the lane's anchor, as `lanes.check_anchors` has it). Each part, and the
    whole, is changed if anything in it changed; else partially-verified if anything in it could
    not be checked; else current. What was never bound says nothing.
    """
    lane = F.when(F.col("state") == "intact", "current").when(F.col("state").isin("truncated", "rewritten"), "changed").otherwise("unavailable")
    mark = F.when(F.col("now").isNull(), "unavailable").when(F.col("bound") == F.col("now"), "current").otherwise("changed")
    parts = {"evidence": evidence.select("case_id", "drift"), "marks": marks.filter("bound is not null").select("case_id", mark.alias("drift")), "lanes": lanes.select("case_id", lane.alias("drift"))}
    all_ = reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(p)) for p, df in parts.items()])
    of = lambda ok: F.when(F.bool_or(ok & (F.col("drift") == "changed")), "changed").when(F.bool_or(ok & (F.col("drift") == "unavailable")), "partially-verified").when(F.bool_or(ok), "current")
    return all_.groupBy("case_id").agg(*[of(F.col("part") == p).alias(p) for p in parts], of(F.lit(True)).alias("state"))


def index_listing(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows (path_key, size_bytes, id, hash_status, kept) of a listing's allocated video entries; a row with the path and equal size stays as it is."""
    l = listing.filter("video_candidate and not deleted").select("path_key", F.col("size_bytes").alias("_size"))
    c = catalog.select("path_key", "size_bytes", "id", "hash_status")
    kept = F.coalesce(F.col("size_bytes") == F.col("_size"), F.lit(False))
    return l.join(c, "path_key", "left").select("path_key", F.col("_size").alias("size_bytes"), F.when(kept, F.col("id")).alias("id"), F.when(kept, F.col("hash_status")).otherwise("not-computed").alias("hash_status"), kept.alias("kept"))


def required_artifacts(required: DataFrame, files: DataFrame) -> DataFrame:
    """Required (case_id, path) that are not among the files."""
    return required.join(files.select("case_id", "path").distinct(), ["case_id", "path"], "left_anti")


#: A pair key of more records is hot.
HOT_PAIR = 20_000


def channel_mates(catalog: DataFrame, salts: int = 16, hot: int = HOT_PAIR) -> DataFrame:
    """(id, mate_id): records with the same non-empty pair key and another channel. A key's records meet in one group; only the right side of a hot key, of more than `hot` records, is dealt over salts."""
    c = catalog.filter("pair_key <> '' and channel is not null").select("id", "pair_key", "channel")
    few, many = parted(c, ["pair_key"], long_keys(c, ["pair_key"], hot))
    met = few.groupBy("pair_key").agg(F.collect_list(F.struct("id", "channel")).alias("a")).filter(F.size("a") > 1)
    pairs = met.select(F.explode("a").alias("l"), "a").select("l", F.explode("a").alias("r")).select(F.col("l.id").alias("id"), F.col("r.id").alias("mate_id"), F.col("l.channel").alias("channel"), F.col("r.channel").alias("_channel"))
    if many is not None:
        left = many.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        right = many.select(F.col("id").alias("mate_id"), "pair_key", F.col("channel").alias("_channel")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        pairs = pairs.unionByName(left.join(right, ["pair_key", "salt"]).select("id", "mate_id", "channel", "_channel"))
    return pairs.filter("id <> mate_id and channel <> _channel").select("id", "mate_id")


def record_status(records: DataFrame, validations: DataFrame) -> DataFrame:
    """id, status: the newest validation of the path (path, line_no, status, usable, after_repair, revalidated) overrides the record's own status; an unusable newest one, or one written before a repair and not confirmed since, leaves it unconfirmed."""
    v = validations.groupBy(F.col("path").alias("_path")).agg(F.max_by(F.struct("status", "usable", "after_repair", "revalidated"), "line_no").alias("v"))
    j = records.join(v, F.col("source_path") == F.col("_path"), "left")
    status = F.when(F.col("v").isNull(), F.coalesce("status", F.lit("extension-candidate"))).when(~F.col("v.usable"), "unconfirmed").when(~F.col("v.after_repair") & ~F.col("v.revalidated"), "unconfirmed").otherwise(F.col("v.status"))
    return j.select("id", status.alias("status"))


def attach_findings(records: DataFrame, findings: DataFrame) -> DataFrame:
    """id, kinds (sorted), usable: findings (selector, kind, usable) gathered by record; of a kind, a usable finding beats an unusable one."""
    by_kind = findings.groupBy("selector", "kind").agg(F.max("usable").alias("usable"))
    f = by_kind.groupBy("selector").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("usable").alias("usable"))
    j = records.select("id").join(f, F.col("id") == F.col("selector"), "left")
    return j.select("id", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce("usable", F.lit(False)).alias("usable"))


def rehash_check(catalog: DataFrame, observed: DataFrame) -> DataFrame:
    """id, result: match, mismatch, missing, unreadable or no-recorded-hash; observed has id, sha256, readable."""
    o = observed.select(F.col("id").alias("_id"), clean_hash(F.col("sha256")).alias("_now"), "readable")
    j = catalog.join(o, catalog["id"] == F.col("_id"), "left")
    was = clean_hash(F.col("sha256"))
    return j.select("id", F.when(F.col("_id").isNull(), "missing").when(~F.col("readable"), "unreadable").when(was.isNull(), "no-recorded-hash").when(was == F.col("_now"), "match").otherwise("mismatch").alias("result"))
