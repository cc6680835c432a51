"""Search, facets, sorting, paging and summaries over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import search_haystack

SEARCH_FIELDS = ("id", "source_path", "parser", "vendor", "sha256", "note", "status")


def search(records: DataFrame, query: str, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """Records with the query as a substring of a field, whatever the case; an empty query finds all."""
    have = [F.col(f) for f in fields if f in records.columns]
    return records.filter(search_haystack(*have).contains(query.lower().replace("\0", "")))


def in_subtree(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def facet_filter(records: DataFrame, kind: str | None = None, rec_type: str | None = None, audio: str | None = None, first_day: str | None = None, last_day: str | None = None, folder: str | None = None, status: str | None = None) -> DataFrame:
    """Records that pass every given facet; a date range drops records without a day."""
    tests = [F.col(c) == v for c, v in (("kind", kind), ("rec_type", rec_type), ("audio", audio), ("status", status)) if v is not None]
    tests += [F.col("day") >= first_day] if first_day else []
    tests += [F.col("day") <= last_day] if last_day else []
    tests += [in_subtree(F.col("dir_path"), folder)] if folder else []
    return records.filter(reduce(Column.__and__, tests)) if tests else records


#: Chips that ask for a flag of the record.
FLAG_CHIPS = {"anomaly": "has_anomaly", "anomaly:unauth": "has_unauth_anomaly", "anomaly:pc": "has_pc_anomaly"}
RECOVERY_KINDS = ("candidate", "filesystem", "repaired")


def chip_filter(records: DataFrame, marks: DataFrame, tags: DataFrame, chip: str, notes: DataFrame | None = None) -> DataFrame:
    """Records that a chip asks for.

    anomaly, anomaly:unauth, anomaly:pc (has_anomaly ... of the record), warning (its
    warnings), kind:recovery (its record_kind), mark:none, mark:<status>, tag:<tag>, and
    marked:any: a mark, a tag or a note that is not blank. Any other chip is an error.
    """
    m = marks.select(F.col("id").alias("_id"), F.col("status").alias("_mark"))
    if chip in FLAG_CHIPS:
        return records.filter(F.coalesce(F.col(FLAG_CHIPS[chip]), F.lit(False)))
    if chip == "warning":
        return records.filter(F.size(F.coalesce("warnings", F.array())) > 0)
    if chip == "kind:recovery":
        return records.filter(F.col("record_kind").isin(*RECOVERY_KINDS))
    if chip.startswith("tag:"):
        hits = tags.filter(F.array_contains("tags", chip[4:])).select(F.col("id").alias("_id"))
    elif chip == "marked:any":
        hits = m.select("_id").unionByName(tags.filter(F.size("tags") > 0).select(F.col("id").alias("_id")))
        if notes is not None:
            hits = hits.unionByName(notes.filter(F.trim("note") != "").select(F.col("id").alias("_id")))
    elif chip == "mark:none":
        return records.join(m, records["id"] == m["_id"], "left_anti")
    elif chip.startswith("mark:"):
        hits = m.filter(F.col("_mark") == chip[5:])
    else:
        raise ValueError(f"unknown chip {chip}")
    return records.join(hits, records["id"] == hits["_id"], "left_semi")


def sort_records(records: DataFrame, by: str = "time") -> DataFrame:
    """Sorted by time, time_desc, name, size or id; rows without a time come last either way, ties go by id."""
    orders = {"time": [F.col("rec_ts").asc_nulls_last()], "time_desc": [F.col("rec_ts").desc_nulls_last()], "name": [F.lower("name").asc_nulls_last()], "size": [F.col("size_bytes").desc_nulls_last()], "id": []}
    return records.orderBy(*orders[by], F.col("id"))


def page(records: DataFrame, order: list[Column], offset: int = 0, limit: int = 500) -> DataFrame:
    """One page of the sorted records; the limit is kept within 1 to 5000."""
    return records.orderBy(*order).offset(max(0, offset)).limit(min(5000, max(1, limit)))


def page_after(records: DataFrame, key: str, last_seen: str | None, limit: int = 500) -> DataFrame:
    """The page behind a key: deep pages cost no more than the first."""
    rest = records if last_seen is None else records.filter(F.col(key) > last_seen)
    return rest.orderBy(key).limit(min(5000, max(1, limit)))


def facet_counts(records: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """facet, value, n: for each facet, records by value that pass the choices of all other facets; one pass over the records."""
    passes = {f: F.coalesce(F.col(f) == v, F.lit(False)) if v is not None else F.lit(True) for f, v in chosen.items()}
    cells = []
    for f in chosen:
        others = reduce(Column.__and__, [p for g, p in passes.items() if g != f], F.lit(True))
        cells.append(F.when(others, F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("none")).alias("value"))))
    return records.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def group_counts(records: DataFrame, by: str) -> DataFrame:
    """value, n; rows without a value count as 'none'."""
    return records.groupBy(F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


def case_summary(videos: DataFrame, runs: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: videos, runs, sources, jobs, running_jobs."""
    parts = [videos.agg(F.count("*").alias("videos")), runs.agg(F.count("*").alias("runs")), sources.agg(F.count("*").alias("sources")), jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "running").alias("running_jobs"))]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def hash_coverage(catalog: DataFrame) -> DataFrame:
    """One row: total, hashed, errors."""
    return catalog.agg(F.count("*").alias("total"), F.count_if(F.coalesce("sha256", F.lit("")) != "").alias("hashed"), F.count_if(F.col("hash_status") == "failed").alias("errors"))


def mark_tally(marks: DataFrame, records: DataFrame) -> DataFrame:
    """status, marks, listed, off_case: marks by status, split by whether the record is in the case."""
    r = records.select(F.col("id").alias("_id")).distinct()
    j = marks.join(r, marks["id"] == r["_id"], "left")
    return j.groupBy("status").agg(F.count("*").alias("marks"), F.count("_id").alias("listed"), (F.count("*") - F.count("_id")).alias("off_case"))


def band_distribution(records: DataFrame, reports: DataFrame) -> DataFrame:
    """band, n: records by screening score: high (0.7), medium (0.4), low, unknown (no score), failed; unscreened ones as none."""
    j = records.select("id").join(reports.select("id", F.col("status").alias("_status"), "score"), "id", "left")
    s = F.col("score")
    band = F.when(F.col("_status").isNull(), "none").when(F.col("_status") == "failed", "failed").when(s.isNull(), "unknown").when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low")
    return j.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def day_histogram(records: DataFrame) -> DataFrame:
    """month, day, n; records without a day are left out."""
    return records.filter("day is not null").groupBy(F.substring("day", 1, 7).alias("month"), "day").agg(F.count("*").alias("n"))


def frames_by_channel(frames: DataFrame) -> DataFrame:
    """file, channel, video_frames, audio_frames, first_channel: the file's channel of its first video frame. A file with a failed walk is left out."""
    bad = frames.filter("failed").select("file").distinct()
    f = frames.join(bad, "file", "left_anti")
    per = f.groupBy("file", "channel").agg(F.count_if("is_video").alias("video_frames"), F.count_if(~F.col("is_video")).alias("audio_frames"), F.min(F.when(F.col("is_video"), F.col("offset"))).alias("_at"))
    first = per.groupBy("file").agg(F.min_by("channel", "_at").alias("first_channel"))
    return per.drop("_at").join(first, "file")


def loudness(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """peak_db, mean_db, state per key: the mean is one of power, weighted by samples. Without samples it is an error, not silence; -Infinity is a level."""
    power = F.sum(F.when(F.col("n_samples") > 0, F.col("n_samples") * F.pow(F.lit(10.0), F.col("mean_db") / 10)))
    n = F.coalesce(F.sum("n_samples"), F.lit(0))
    d = blocks.groupBy(*keys).agg(n.alias("n_samples"), F.max(F.when(F.col("n_samples") > 0, F.col("max_db"))).alias("peak_db"), power.alias("_p"))
    mean = F.when(F.col("n_samples") > 0, F.when(F.col("_p") > 0, 10 * F.log10(F.col("_p") / F.col("n_samples"))).otherwise(F.lit(float("-inf"))))
    return d.withColumns({"mean_db": mean, "state": F.when(F.col("n_samples") > 0, "measured").otherwise("error")}).drop("_p")


SILENCE_DB = -70.0


def record_verdict(streams: DataFrame, records: DataFrame) -> DataFrame:
    """id, verdict: no-audio without streams, sound if any stream has some, silent if all are silent, else error. A stream counts as measured if its measurement covers the track: within 1 s, or within 0.25 s or 95 % of a short one."""
    missing = F.col("track_s") - F.col("measured_s")
    covers = ~((missing > 1) | ((missing > 0.25) & (F.col("measured_s") < 0.95 * F.col("track_s"))))
    state = F.when(F.col("n_samples") <= 0, "error").when(~covers, "error").when(F.col("peak_db") <= SILENCE_DB, "silent").otherwise("sound")
    s = streams.withColumn("_s", state).groupBy("id").agg(F.bool_or(F.col("_s") == "sound").alias("_any"), F.bool_and(F.col("_s") == "silent").alias("_all"))
    j = records.select("id").join(s, "id", "left")
    return j.select("id", F.when(F.col("_any").isNull(), "no-audio").when(F.col("_any"), "sound").when(F.col("_all"), "silent").otherwise("error").alias("verdict"))


def track_summary(points: DataFrame, cap: int = 20_000) -> DataFrame:
    """file, kept, total, truncated, first_ts, last_ts, max_speed over the first `cap` points of a file (the cap is part of the result)."""
    from pyspark.sql.window import Window

    p = points.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("offset")))
    kept = F.col("_n") <= cap
    return p.groupBy("file").agg(F.count_if(kept).alias("kept"), F.count("*").alias("total"), (F.count("*") > cap).alias("truncated"), F.min(F.when(kept, F.col("ts"))).alias("first_ts"), F.max(F.when(kept, F.col("ts"))).alias("last_ts"), F.max(F.when(kept, F.col("speed"))).alias("max_speed"))


def grade_counts(deleted: DataFrame) -> DataFrame:
    """grade, n, bytes of deleted entries."""
    return deleted.groupBy("grade").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def set_fingerprint(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, digest: the same for the same set of values, whatever their order or repeats. Sums and exclusive ors of hashes, so that a large set needs no sort and no list."""
    d = rows.select(group, F.col(value).cast("string").alias("v")).distinct()
    h = F.xxhash64("v").cast("decimal(20,0)")
    g = d.groupBy(group).agg(F.count("v").alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(F.lit("x"), "v")).alias("x"))
    return g.select(group, "n", F.sha2(F.concat_ws(":", "n", "s", "x"), 256).alias("digest"))


def ordered_fingerprint(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, digest of the sorted distinct values, for groups of bounded size; any tool can recompute it."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_set(F.col(value).cast("string"))).alias("vs"))
    return g.select(group, F.size("vs").alias("n"), F.sha2(F.concat_ws("\n", "vs"), 256).alias("digest"))


def carve_run_listing(lines: DataFrame) -> DataFrame:
    """run_rank, run_id, id, status: the last line of each (run, id); newest run first, lines without a run last."""
    from pyspark.sql.window import Window

    last = lines.groupBy("run_id", "id").agg(F.max_by(F.struct("status", "ts"), "line_no").alias("e"))
    runs = lines.groupBy("run_id").agg(F.max("ts").alias("run_ts"))
    runs = runs.withColumn("run_rank", F.dense_rank().over(Window.orderBy(F.col("run_id").isNull(), F.desc("run_ts"), "run_id")))
    return last.join(runs, last["run_id"].eqNullSafe(runs["run_id"])).select("run_rank", last["run_id"], "id", F.col("e.status").alias("status"))


def all_records(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """The record kinds under one schema; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("record_kind", F.lit(k)) for k, df in kinds])


def all_findings(detectors: dict[str, DataFrame]) -> DataFrame:
    """kind, selector, source_path, detail, detector: every detector's findings, and for one without any a row of kind no-findings."""
    cols = ["kind", "selector", "source_path", "detail"]
    spark = next(iter(detectors.values())).sparkSession
    found = reduce(DataFrame.unionByName, [d.select(*[F.col(c).cast("string").alias(c) for c in cols], F.lit(n).alias("detector")) for n, d in detectors.items()])
    names = spark.createDataFrame([(n,) for n in detectors], "detector string")
    none = names.join(found.select("detector").distinct(), "detector", "left_anti").select(F.lit("no-findings").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in cols[1:]], "detector")
    return found.unionByName(none)


def gate_report(checks: DataFrame) -> DataFrame:
    """check, verdict: PASS, FAIL or BLOCKED (input missing) of named checks (check, ready, ok), and an overall row: blocked by any blocked one, failed by any failed one."""
    verdict = F.when(~F.col("ready"), "BLOCKED").when(F.coalesce("ok", F.lit(False)), "PASS").otherwise("FAIL")
    rows = checks.select("check", verdict.alias("verdict"))
    overall = rows.agg(F.when(F.bool_or(F.col("verdict") == "FAIL"), "FAIL").when(F.bool_or(F.col("verdict") == "BLOCKED"), "BLOCKED").otherwise("PASS").alias("verdict"))
    return rows.unionByName(overall.select(F.lit("overall").alias("check"), "verdict"))


#: Fixed value: rows that an index must take in a minute.
LEAST_ROWS_PER_MINUTE = 50_000


def release_gate(missing_artifacts: DataFrame | None = None, accuracy: DataFrame | None = None, reproducibility: DataFrame | None = None, performance: DataFrame | None = None, audit_chain: DataFrame | None = None, consistency: DataFrame | None = None) -> DataFrame:
    """`gate_report` of the six release checks; one without its input is BLOCKED.

    report_defense: no `required_artifacts` are missing; accuracy and reproducibility: the
    results of those operators; performance: one row (rows, elapsed_ms); audit_chain: states of
    `check_anchors`, at least one and all intact; consistency: no differences.
    """
    none = F.count("*") == 0
    rate = F.when(F.col("elapsed_ms") > 0, F.floor(F.col("rows") * 60_000 / F.col("elapsed_ms"))).otherwise(F.col("rows") * 60_000)
    checks = {
        "report_defense": (missing_artifacts, none),
        "accuracy": (accuracy, F.bool_and("passed")),
        "reproducibility": (reproducibility, F.bool_and("reproducible")),
        "performance": (performance, F.bool_and(rate >= LEAST_ROWS_PER_MINUTE)),
        "audit_chain": (audit_chain, F.bool_and(F.col("state") == "intact")),
        "consistency": (consistency, none),
    }
    given = [df.agg(ok.alias("ok")).select(F.lit(name).alias("check"), F.lit(True).alias("ready"), "ok") for name, (df, ok) in checks.items() if df is not None]
    if not given:
        raise ValueError("no check has its input")
    blocked = [(name, False, None) for name, (df, _) in checks.items() if df is None]
    return gate_report(reduce(DataFrame.unionByName, [*given, given[0].sparkSession.createDataFrame(blocked, "check string, ready boolean, ok boolean")]))
