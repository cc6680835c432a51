"""Upserts, case merges, annotations and their history, the source registry, timelines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .sequence import assign_ids, mark_duplicates, record_number

#: Rows whose order is not known come last.
LAST = (1 << 63) - 1


def upsert_catalog(current: DataFrame, incoming: DataFrame, stamp: int) -> DataFrame:
    """The next snapshot (id, source_path, sha256, first_indexed, last_indexed): an incoming row replaces those with its id or its path; the first index time is kept."""
    inc = incoming.select("id", "source_path", "sha256")
    by_id = current.select(F.col("id").alias("_id"), F.col("first_indexed").alias("_f1"))
    by_path = current.groupBy(F.col("source_path").alias("_path")).agg(F.min("first_indexed").alias("_f2"))
    new = inc.join(by_id, inc["id"] == F.col("_id"), "left").join(by_path, inc["source_path"] == F.col("_path"), "left")
    new = new.select("id", "source_path", "sha256", F.least(F.coalesce("_f1", "_f2", F.lit(stamp)), F.coalesce("_f2", "_f1", F.lit(stamp))).cast("long").alias("first_indexed"), F.lit(stamp).cast("long").alias("last_indexed"))
    rest = current.join(inc.select("id"), "id", "left_anti").join(inc.select("source_path"), "source_path", "left_anti")
    return rest.select("id", "source_path", "sha256", "first_indexed", "last_indexed").unionByName(new)


def merge_cases(target: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The merged catalog: id, path_key, sha256, merged_from, merged_from_id, duplicate_of, provenance.

    target and sources: id, path_key, sha256 and, if the rows' order in their file is known,
    line. A source row whose path key is there adds provenance to that row; any other gets a new
    id, in the order of the sources and of their rows: by line, else by the number in the id.
    duplicate_of names the first row of the same hash; unhashed rows never duplicate.
    """
    if any(df is target for _, df in sources):
        raise ValueError("a case cannot be merged into itself")
    def part(k: int, case: str | None, df: DataFrame) -> DataFrame:
        line = F.col("line").cast("long") if "line" in df.columns else record_number(F.col("id"))
        return df.select(F.lit(k).alias("src"), F.lit(case).cast("string").alias("case"), F.coalesce(line, F.lit(LAST)).alias("line"), "id", "path_key", "sha256")

    all_ = reduce(DataFrame.unionByName, [part(0, None, target), *[part(k, case, df) for k, (case, df) in enumerate(sources, start=1)]])
    first = all_.groupBy("path_key").agg(
        F.min_by(F.struct("src", "case", "line", "id", "sha256"), F.struct("src", "line", "id")).alias("f"),
        F.array_sort(F.collect_set(F.when(F.col("src") > 0, F.concat("case", F.lit(":"), "id")))).alias("provenance"),
    )
    rows = first.select("path_key", "f.src", "f.case", "f.line", F.col("f.id").alias("old_id"), "f.sha256", "provenance")
    digits = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    fresh = rows.filter("src > 0").select(F.concat(digits("src"), digits("line"), F.lit("\0"), "old_id", F.lit("\0"), "path_key").alias("order_key"), "path_key")
    ids = assign_ids(fresh.select(F.col("order_key").alias("path_key")), target.select(F.lit(None).cast("string").alias("path_key"), "id"))
    fresh = fresh.join(ids.withColumnRenamed("path_key", "order_key"), "order_key").select(F.col("path_key").alias("_p"), F.col("id").alias("_new"))
    merged = rows.join(fresh, rows["path_key"] == F.col("_p"), "left").select(
        F.coalesce("_new", "old_id").alias("id"), "path_key", "sha256",
        F.when(F.col("src") > 0, F.col("case")).alias("merged_from"), F.when(F.col("src") > 0, F.col("old_id")).alias("merged_from_id"), "src", "line", "provenance",
    )
    return mark_duplicates(merged, ["src", "line"]).drop("src", "line")


def merge_marks(target: DataFrame, source: DataFrame, id_map: DataFrame) -> DataFrame:
    """id, status, note, outcome (target, source, conflict): marks of both cases under the target's ids. The target's status wins; notes are joined once. Marks whose id is not mapped have outcome unmapped."""
    s = source.join(id_map.select(F.col("source_id").alias("id"), "target_id"), "id", "left")
    s = s.select(F.col("target_id").alias("_id"), F.col("id").alias("_old"), F.col("status").alias("_status"), F.col("note").alias("_note"))
    mapped = target.join(s.filter("_id is not null"), target["id"] == F.col("_id"), "full_outer")
    both = F.col("id").isNotNull() & F.col("_id").isNotNull()
    note = F.when(F.coalesce(F.col("note"), F.lit("")).contains(F.coalesce("_note", F.lit(""))), F.col("note")).otherwise(F.concat_ws("\n", F.nullif("note", F.lit("")), F.nullif("_note", F.lit(""))))
    outcome = F.when(both & ~F.col("status").eqNullSafe(F.col("_status")), "conflict").when(F.col("id").isNotNull(), "target").otherwise("source")
    out = mapped.select(F.coalesce("id", "_id").alias("id"), F.coalesce("status", "_status").alias("status"), note.alias("note"), outcome.alias("outcome"))
    lost = s.filter("_id is null").select(F.col("_old").alias("id"), F.col("_status").alias("status"), F.col("_note").alias("note"), F.lit("unmapped").alias("outcome"))
    return out.unionByName(lost)


def tag_union(*tag_sets: DataFrame) -> DataFrame:
    """id, tags: the sorted union of all tag sets of an id."""
    exploded = reduce(DataFrame.unionByName, [t.select("id", F.explode("tags").alias("tag")) for t in tag_sets])
    return exploded.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def apply_patch(state: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, conflicts, history) of one batch with a row per id at most.

    state: id, status, note, revision, client_id, deleted; patch: id, base_revision,
    client_id, delete, status, note (null: keep). A patch conflicts if its base is not the
    stored revision, unless the same client wrote that. Equal content changes nothing, not
    even the revision. A deleted row keeps its revision as a tombstone.
    """
    p = patch.select(F.col("id").alias("_id"), "base_revision", F.col("client_id").alias("_client"), "delete", F.col("status").alias("_status"), F.col("note").alias("_note"))
    j = state.join(p, state["id"] == F.col("_id"), "full_outer")
    patched, known = F.col("_id").isNotNull(), F.col("id").isNotNull()
    revision = F.coalesce("revision", F.lit(0))
    conflict = patched & (F.coalesce("base_revision", F.lit(0)) != revision) & ~(known & F.col("_client").eqNullSafe(F.col("client_id")))
    deleted = F.coalesce("deleted", F.lit(False))
    status, note, gone = F.coalesce("_status", F.when(~deleted, F.col("status"))), F.coalesce("_note", F.when(~deleted, F.col("note"))), F.coalesce("delete", F.lit(False))
    same = F.when(gone, deleted | ~known).otherwise(~deleted & status.eqNullSafe(F.col("status")) & note.eqNullSafe(F.col("note")) & known)
    change = patched & ~conflict & ~same
    j = j.withColumns({"_conflict": conflict, "_change": change, "_s": status, "_n": note, "_gone": gone, "_rev": revision, "_was": deleted})
    pick = lambda new, old: F.when(F.col("_change"), new).otherwise(old)
    new = j.filter("id is not null or _change").select(
        F.coalesce("id", "_id").alias("id"), pick(F.when(~F.col("_gone"), F.col("_s")), F.col("status")).alias("status"), pick(F.when(~F.col("_gone"), F.col("_n")), F.col("note")).alias("note"),
        pick(F.col("_rev") + 1, F.col("_rev")).cast("long").alias("revision"), pick(F.col("_client"), F.col("client_id")).alias("client_id"), pick(F.col("_gone"), F.col("_was")).alias("deleted"),
    )
    conflicts = j.filter("_conflict").select(F.col("_id").alias("id"), "base_revision", F.col("_rev").cast("long").alias("revision"))
    history = j.filter("_change").select(F.coalesce("id", "_id").alias("id"), F.col("status").alias("old_status"), F.when(~F.col("_gone"), F.col("_s")).alias("new_status"), F.col("note").alias("old_note"), F.when(~F.col("_gone"), F.col("_n")).alias("new_note"))
    return new, conflicts, history


def annotation_history(before: DataFrame, after: DataFrame, stamp: int) -> DataFrame:
    """id, old_status, new_status, changed_unix: a row for each mark that differs between two snapshots."""
    b, a = before.select("id", F.col("status").alias("old_status")), after.select("id", F.col("status").alias("new_status"))
    j = b.join(a, "id", "full_outer").filter(~F.col("old_status").eqNullSafe(F.col("new_status")))
    return j.withColumn("changed_unix", F.lit(stamp).cast("long"))


HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}


def source_registry(registrations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, changes, errors) from registrations (seq, kind, path, custodian, note, auto_note, hash, algorithm, computed).

    A source is src_ and 16 hex digits of its path's SHA-256. A new non-null value replaces
    the old one, a missing one keeps it; an automatic note never replaces one by a person,
    and a declared hash never a computed one. A hash whose length does not fit its algorithm is an error.
    changes: seq, source_id, field (custodian, note, hash), was, now: what a registration put in
    the place of another value.
    """
    lengths = F.element_at(F.create_map(*[F.lit(x) for kv in HASH_LENGTHS.items() for x in kv]), F.lower("algorithm"))
    bad = F.col("hash").isNotNull() & (lengths.isNull() | (F.length("hash") != lengths))
    r = registrations.withColumn("source_id", F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("\0", "kind", "path"), 256), 1, 16)))
    errors, good = r.filter(bad).select("seq", "source_id", "algorithm", "hash"), r.filter(~bad)
    latest = lambda c, ok=None: F.max_by(c, F.when(F.col(c).isNotNull() if ok is None else F.col(c).isNotNull() & ok, F.col("seq")))
    g = good.groupBy("source_id", "kind", "path").agg(
        latest("custodian").alias("custodian"),
        F.coalesce(latest("note", ~F.col("auto_note")), latest("note", F.col("auto_note"))).alias("note"),
        F.coalesce(latest("hash", F.col("computed")), latest("hash", ~F.col("computed"))).alias("hash"),
    )
    along = Window.partitionBy("source_id").orderBy("seq")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest_of = lambda c, ok: F.last(F.when(ok, F.col(c)), ignorenulls=True).over(so_far)
    held = good.withColumns({
        "_custodian": latest_of("custodian", F.lit(True)),
        "_note": F.coalesce(latest_of("note", ~F.col("auto_note")), latest_of("note", F.col("auto_note"))),
        "_hash": F.coalesce(latest_of("hash", F.col("computed")), latest_of("hash", ~F.col("computed"))),
    })
    held = held.withColumns({f"_was_{f}": F.lag(f"_{f}").over(along) for f in ("custodian", "note", "hash")})
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"_was_{f}").alias("was"), F.col(f"_{f}").alias("now")) for f in ("custodian", "note", "hash")]
    changes = held.select("seq", "source_id", F.explode(F.array(*fields)).alias("c")).select("seq", "source_id", "c.*").filter("was is not null and was <> now")
    return g, changes, errors


def reproducible(a: DataFrame, b: DataFrame, zeroed: tuple[str, ...] = ("stale_since",)) -> DataFrame:
    """One row: only_a, only_b, reproducible. The normalised lines of two runs as multisets; columns in `zeroed` are left out of account."""
    cols = sorted(set(a.columns) - set(zeroed))
    line = lambda df: df.select(F.to_json(F.struct(*cols)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    j = line(a).withColumnRenamed("n", "na").join(line(b).withColumnRenamed("n", "nb"), "line", "full_outer")
    d = F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))
    out = j.agg(F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-d, F.lit(0))), F.lit(0)).alias("only_b"))
    return out.withColumn("reproducible", (F.col("only_a") == 0) & (F.col("only_b") == 0))


#: Fixed value: the kind of an entry that is not usable here.
UNAUTHENTICATED = "audit-entry-unauthenticated"


def timeline(catalog: DataFrame, carve: DataFrame, lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, coverage). events: ts_unix, source, kind, path, detail, time_unaudited, time_self_consistent; sort them by the first five.

    catalog (id, source_path, modified_unix, stale, stale_since, creation): mtimes, stale marks
    and creation tags, whose times no log vouches for: all are unaudited. carve (path, ts,
    signature, trust) and lanes (lane, ts, event, path, trust): an entry that is not usable
    here is of an unauthenticated kind and unaudited; one that only its own chain vouches for
    is self-consistent. What has no time is left out and counted in the coverage (source,
    events, without_time).
    """
    from ..functions.times import creation_time
    from .lanes import USABLE

    def part(df: DataFrame, ts, source: str, kind, path, detail, audited=None, own=None) -> DataFrame:
        no = F.lit(False)
        flags = (F.lit(True) if audited is None else ~audited).alias("time_unaudited"), (no if own is None else own).alias("time_self_consistent")
        return df.select(ts.cast("long").alias("ts_unix"), F.lit(source).alias("source"), kind.alias("kind"), path.alias("path"), detail.alias("detail"), *flags)

    tag = catalog.filter("creation is not null").withColumn("_c", creation_time(F.col("creation")))
    usable = F.coalesce(F.col("trust").isin(*USABLE), F.lit(False))
    own = usable & (F.col("trust") != "authenticated")
    video = lambda *rest: F.concat(F.lit("indexed video "), "id", *[F.lit(r) if isinstance(r, str) else r for r in rest])
    zone = F.when(F.col("_c.tz_assumed"), " (zone assumed UTC)").otherwise(" (zone not verified)")
    parts = [
        part(catalog, F.nullif("modified_unix", F.lit(0)), "index", F.lit("file-modified"), F.col("source_path"), video(" filesystem mtime")),
        part(catalog.filter("stale"), F.col("stale_since"), "index", F.lit("file-marked-stale"), F.col("source_path"), video(" marked stale by rescan")),
        part(tag, F.col("_c.unix"), "ffprobe", F.lit("media-creation-time"), F.col("source_path"), video(" ffprobe format creation_time ", F.col("creation"), zone)),
        part(carve, F.col("ts"), "carve", F.when(usable, "carved-candidate").otherwise(UNAUTHENTICATED), F.col("path"), F.col("signature"), usable, own),
        part(lanes, F.col("ts"), "audit-log", F.when(usable, "audit-event").otherwise(UNAUTHENTICATED), F.col("path"), F.concat(F.lit("audit event '"), "event", F.lit("' recorded in "), "lane"), usable, own),
    ]
    all_ = reduce(DataFrame.unionByName, parts)
    coverage = all_.groupBy("source").agg(F.count("ts_unix").alias("events"), (F.count("*") - F.count("ts_unix")).alias("without_time"))
    return all_.filter("ts_unix is not null"), coverage


def in_time_order(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Events in their total order: ranges of time by partition (the session's number unless given), each sorted."""
    cols = [F.col(c) for c in ("ts_unix", "source", "kind", "path", "detail")]
    ranged = events.repartitionByRange(*cols) if partitions is None else events.repartitionByRange(partitions, *cols)
    return ranged.sortWithinPartitions(*cols)


@dataclass(frozen=True)
class Annotations:
    """A case's annotations. marks: id, status, marked_unix, examiner, note, range_in, range_out; tags: id, tags; history: id, action, changed_unix, old_status, new_status, old_note, new_note, detail, and history_pk where it is copied from."""

    marks: DataFrame
    tags: DataFrame
    history: DataFrame


MARK_FIELDS = ("status", "marked_unix", "examiner", "note", "range_in", "range_out")
HISTORY_FIELDS = ("id", "action", "changed_unix", "old_status", "new_status", "old_note", "new_note", "detail")
#: How a copied history row is named in its detail, and a merged note begins.
COPIED_FROM, MERGED_NOTE = "merged-history from ", "[병합 "


def merge_annotations(target: Annotations, source: Annotations, id_map: DataFrame, source_case: str, now: int) -> tuple[Annotations, DataFrame]:
    """(merged annotations, counts) of a source case merged into a target.

    id_map: source_id, target_id, one to one; what is not mapped is counted. A mark of the target
    stays, with the source's note behind its own once; where the two differ that is a conflict, and
    the whole source mark goes into the history. A record without a mark takes the source's.
    Tags are united. History rows are copied once, under a key of their case, record and
    number; each record that the merge touches gets one row of its own. The history is the
    ledger: what it already holds is not done again, so merging twice is merging once.
    """
    ids = id_map.groupBy(F.col("source_id").alias("_from")).agg(F.min("target_id").alias("_to"))
    case = F.lit(source_case)

    sm = source.marks.select(F.col("id").alias("_from"), F.struct(*MARK_FIELDS).alias("_s")).join(ids, "_from")
    st = source.tags.groupBy(F.col("id").alias("_from")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("_tags")).filter(F.size("_tags") > 0).join(ids, "_from")
    sh = source.history.withColumnRenamed("id", "_from").join(ids, "_from")
    key = F.concat(F.lit(COPIED_FROM), case, F.lit(" record "), "_from", F.lit(" history_pk "), F.col("history_pk").cast("string"))
    sh = sh.withColumn("_key", key).withColumn("detail", F.concat("_key", F.coalesce(F.concat(F.lit("\noriginal detail: "), "detail"), F.lit(""))))
    held = target.history.select(F.col("id").alias("_to"), F.regexp_extract("detail", rf"(?s)\A({COPIED_FROM}.*? history_pk [0-9]+)(?:\n.*)?\z", 1).alias("_key")).filter("_key <> ''").distinct()
    copied = sh.join(held, ["_to", "_key"], "left_anti")

    tm = target.marks.select(F.col("id").alias("_to"), F.struct(*MARK_FIELDS).alias("_t"))
    tt = target.tags.select(F.col("id").alias("_to"), F.array_sort(F.array_distinct("tags")).alias("_had"))
    touched = sm.select("_from", "_to").union(st.select("_from", "_to")).union(sh.select("_from", "_to")).distinct()
    j = touched.join(sm.drop("_from"), "_to", "left").join(st.drop("_from"), "_to", "left").join(tm, "_to", "left").join(tt, "_to", "left")
    j = j.join(copied.groupBy("_to").agg(F.count("*").alias("_copied")), "_to", "left")
    s, t = F.col("_s"), F.col("_t")
    both = s.isNotNull() & t.isNotNull()
    note_differs = both & (F.trim(F.coalesce(s["note"], F.lit(""))) != "") & ~t["note"].eqNullSafe(s["note"])
    others = [~t[f].eqNullSafe(s[f]) for f in MARK_FIELDS if f != "note"]
    segment = F.concat(F.lit(MERGED_NOTE), case, F.lit(" "), "_from", F.lit("] "), s["note"])
    line = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    had_note = F.coalesce(t["note"], F.lit(""))
    append = note_differs & ~line(had_note).contains(line(segment))
    union = F.array_sort(F.array_union(F.coalesce("_had", F.array().cast("array<string>")), F.coalesce("_tags", F.array().cast("array<string>"))))
    j = j.withColumns({
        "_insert": s.isNotNull() & t.isNull(), "_append": append, "_conflict": both & reduce(Column.__or__, [note_differs, *others]), "_union": union,
        "_tagged": F.size(union) > F.size(F.coalesce("_had", F.array().cast("array<string>"))),
        "_note": F.when(append, F.when(F.trim(had_note) == "", segment).otherwise(F.concat(had_note, F.lit("\n"), segment))).otherwise(F.when(t.isNotNull(), t["note"]).otherwise(s["note"])),
    })
    j = j.withColumn("_detail", F.to_json(F.struct(F.lit("merge-cases").alias("event"), case.alias("source_case"), F.col("_from").alias("original_id"), F.col("_to").alias("new_id"), s.alias("source_mark"), F.col("_tags").alias("source_tags"))))
    j = j.withColumn("_action", F.when(F.col("_conflict"), "merge-skipped").otherwise("merge"))
    said = target.history.filter("action = 'merge-skipped'").select(F.col("id").alias("_to"), F.col("detail").alias("_detail"), F.lit(True).alias("_said")).distinct()
    j = written(j.join(said, ["_to", "_detail"], "left").withColumn("_changed", F.col("_insert") | F.col("_append") | F.col("_tagged")))

    now_marks = j.filter("_insert or _append")
    fields = [F.when(F.col("_insert"), s[f]).otherwise(t[f]).alias(f) if f != "note" else F.col("_note").alias(f) for f in MARK_FIELDS]
    marks = target.marks.select("id", *MARK_FIELDS).join(now_marks.select(F.col("_to").alias("id")), "id", "left_anti").unionByName(now_marks.select(F.col("_to").alias("id"), *fields))
    now_tags = j.filter("_tagged")
    tags = target.tags.select("id", "tags").join(now_tags.select(F.col("_to").alias("id")), "id", "left_anti").unionByName(now_tags.select(F.col("_to").alias("id"), F.col("_union").alias("tags")))
    needed = j.filter(F.col("_changed") | (F.coalesce("_copied", F.lit(0)) > 0) | (F.col("_conflict") & F.col("_said").isNull()))
    own = needed.select(
        F.col("_to").alias("id"), F.col("_action").alias("action"), F.lit(now).cast("long").alias("changed_unix"), t["status"].alias("old_status"), F.when(t.isNotNull(), t["status"]).otherwise(s["status"]).alias("new_status"),
        t["note"].alias("old_note"), F.col("_note").alias("new_note"), F.col("_detail").alias("detail"),
    )
    history = target.history.select(*HISTORY_FIELDS).unionByName(copied.withColumnRenamed("_to", "id").select(*HISTORY_FIELDS)).unionByName(own)
    everything = source.marks.select("id").union(source.tags.select("id")).union(source.history.select("id")).distinct()
    lost = everything.join(ids, F.col("id") == F.col("_from"), "left_anti").agg(F.count("*").alias("annotations_unmapped"))
    counts = j.agg(
        F.count_if("_insert").alias("marks_merged"), F.count_if("_conflict").alias("marks_conflicted"), F.count_if("_append").alias("notes_appended"), F.count_if("_tagged").alias("tags_merged"),
        F.coalesce(F.sum("_copied"), F.lit(0)).cast("long").alias("history_rows_copied"),
    )
    return Annotations(marks, tags, history), counts.crossJoin(F.broadcast(lost))
