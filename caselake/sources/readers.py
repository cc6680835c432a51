"""Readers of catalogs, lists, listings, logs, annotations and side reports.

Each gives the rows, and a coverage table that counts what could not be read: nothing is
dropped in silence.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from pyspark.sql.window import Window

from ..session import reachable
from .chunks import opened

RECORD_SCHEMA = """
id string, source_path string, source_path_raw_hex string, relative_path string, extension string, size_bytes bigint,
modified_unix bigint, sha256 string, hash_status string, ffprobe_ok boolean, ffprobe_error string, duration_seconds double,
format_name string, video_codec string, audio_codec string, width int, height int, fps double, confidence string,
source_profile struct<lane:string,vendor:string,parser:string,confidence:string,recommended_action:string,evidence:array<string>>,
index_status string, stale_since_unix bigint
"""


def records_from_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) parsed as records: the record's fields, bad_line, stale."""
    parsed = lines.withColumn("r", F.from_json("value", f"{RECORD_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    out = parsed.select("r.*", F.col("r._bad").isNotNull().alias("bad_line"), F.col("value").alias("line")).drop("_bad")
    return out.withColumns({"modified_unix": F.nullif("modified_unix", F.lit(0).cast("long")), "stale": F.coalesce(F.col("index_status") == "stale", F.lit(False))})


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    has_id = F.coalesce("id", F.lit("")) != ""
    rows = parsed.filter(~F.col("bad_line") & has_id).drop("bad_line", "line")
    coverage = parsed.agg(
        F.count("*").alias("lines"), F.count_if(~F.col("bad_line") & has_id).alias("records"), F.count_if(F.col("bad_line")).alias("bad_lines"),
        F.count_if(~F.col("bad_line") & ~has_id).alias("without_id"), F.count_if(F.col("stale") & has_id).alias("stale"),
    )
    return rows, coverage


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, coverage) of a catalog in JSON lines. Blank lines are none; a zero mtime is no mtime."""
    return split_records(records_from_lines(spark.read.text(path).filter(F.trim("value") != "")))


def hashes_from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sha256, coverage) of lines (value): the first CSV field of each, distinct, in lower case; # and ; comments are skipped."""
    t = lines.withColumn("v", F.trim("value")).filter("v <> '' and not startswith(v, '#') and not startswith(v, ';')")
    t = t.withColumn("sha256", F.lower(F.regexp_replace(F.get(F.split("v", ","), F.lit(0)), r'^["\s]+|["\s]+$', "")))
    ok = F.col("sha256").rlike("^[0-9a-f]{64}$")
    return t.filter(ok).select("sha256").distinct(), t.agg(F.count_if(ok).alias("read"), F.count_if(~ok).alias("ignored"))


def read_hash_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return hashes_from_lines(spark.read.text(path))


def manifest_from_lines(lines: DataFrame) -> DataFrame:
    """source_path, sha256 (null: path only) of tab-separated lines (value); header, comments and blank lines are skipped."""
    t = lines.filter("trim(value) <> '' and not startswith(value, '#')").withColumn("f", F.split("value", "\t"))
    t = t.select(F.trim(F.get("f", F.lit(0))).alias("source_path"), F.nullif(F.lower(F.trim(F.get("f", F.lit(1)))), F.lit("")).alias("sha256"))
    return t.filter("source_path <> '' and lower(source_path) <> 'source_path'")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_from_lines(spark.read.text(path))


VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "dav", "ts", "mpg", "mpeg", "h264", "264", "265", "asf", "wmv", "3gp", "m4v", "webm")


def listing_from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, coverage) of long-listing lines: type, inode, path, deleted, video_candidate, size_bytes. Folders and virtual entries are never candidates."""
    f = F.split("value", "\t")
    head = F.get(f, F.lit(0))
    p = lines.filter("trim(value) <> ''").select("value", *[F.regexp_extract(head, r"^(\S+)\s+(\*\s+)?([0-9\-]+)(?:\(realloc\))?:$", k).alias(n) for k, n in ((1, "type"), (2, "star"), (3, "inode"))], F.get(f, F.lit(1)).alias("path"), F.get(f, F.lit(6)).try_cast("long").alias("size_bytes"))
    ok = (F.col("inode") != "") & F.col("path").isNotNull()
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    video = ext.isin(*VIDEO_EXTENSIONS) & F.col("type").rlike(r"^(r|-)/r|^-/-") & ~F.col("type").rlike("[dvV]")
    rows = p.filter(ok).select("type", "inode", "path", (F.col("star") != "").alias("deleted"), video.alias("video_candidate"), "size_bytes")
    return rows, p.agg(F.count_if(ok).alias("entries"), F.count_if(~ok).alias("bad_lines"))


def read_fs_listing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return listing_from_lines(spark.read.text(path))


MARK_STATUSES = ("reviewed", "important", "needs_verification", "noted")
ANNOTATIONS = "schema_version int, case_id string, marks array<struct<id:string,status:string,marked_unix:bigint,examiner:string,note:string,range:map<string,double>>>, tags array<struct<id:string,tags:array<string>>>"


def read_annotations(spark: SparkSession, path: str, case_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, tags, errors) of annotation documents. A document of another case or version is refused whole; a mark with an unknown status, an unknown range key, or a range out of order is an error."""
    docs = spark.read.schema(ANNOTATIONS + ", _bad string").json(path, multiLine=True, columnNameOfCorruptRecord="_bad").withColumn("file", F.col("_metadata.file_path"))
    refused = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.coalesce("schema_version", F.lit(0)) != 1, "unknown-version").when(F.col("case_id") != case_id, "other-case")
    docs = docs.withColumn("error", refused)
    marks = docs.filter("error is null").select("file", F.explode("marks").alias("m")).select("file", "m.*")
    keys = F.coalesce(F.map_keys("range"), F.array().cast("array<string>"))
    lo, hi = F.element_at("range", F.lit("in")), F.element_at("range", F.lit("out"))
    wrong = F.when(F.coalesce("id", F.lit("")) == "", "no-id").when(~F.coalesce(F.col("status").isin(*MARK_STATUSES), F.lit(False)), "unknown-status").when(F.size(F.array_except(keys, F.array(F.lit("in"), F.lit("out")))) > 0, "unknown-range-key").when((lo < 0) | (hi < lo), "bad-range")
    marks = marks.withColumn("error", wrong)
    tags = docs.filter("error is null").select(F.explode("tags").alias("t")).select("t.*")
    errors = docs.filter("error is not null").select("file", F.lit(None).cast("string").alias("id"), "error").unionByName(marks.filter("error is not null").select("file", "id", "error"))
    good = marks.filter("error is null").select("id", "status", "marked_unix", "examiner", "note", F.element_at("range", F.lit("in")).alias("range_in"), F.element_at("range", F.lit("out")).alias("range_out"))
    return good, tags, errors


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One report per record: the report's fields and the record's id, which is the file's stem."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumn("id", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", ""))


def lines_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, torn) of whole lanes (lane, value): lane, line_no, raw, with blank lines as rows; torn lists lanes whose last line has no end."""
    whole = texts.filter("value <> ''")
    torn = whole.filter(~F.col("value").endswith("\n")).select("lane")
    body = F.regexp_replace("value", r"\n\z", "")
    lines = whole.select("lane", F.posexplode(F.split(body, "\n", -1)).alias("at", "raw"))
    return lines.select("lane", (F.col("at") + 1).cast("long").alias("line_no"), "raw"), torn


def read_lanes(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(lines, torn) of all logs below a case folder; the lane is the path below it.

    lines: lane, line_no, raw, with blank lines as rows; torn lists lanes whose last line has no
    end. Only line feeds end lines. A lane is read in as many splits as the session's
    `spark.sql.files.maxPartitionBytes` makes of it; each split has the lines that begin in it.
    They are numbered in two passes: the lines of each split are counted, the counts summed
    along the lane (a row for each split), and a line's number is its place in its split behind
    that sum. Both passes scan the same splits in the same order, whatever machine runs them.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    top = root.removeprefix("file:").rstrip("/") + "/"
    lane = F.when(name.startswith(top), F.substr(name, F.lit(len(top) + 1))).otherwise(name)
    rows = files.select(lane.alias("lane"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("_size"), "value", F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("lane", "split", "_size").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    before = Window.partitionBy("lane").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counted = splits.select(F.col("lane").alias("_lane"), F.col("split").alias("_split"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # The reader takes away a byte order mark at a file's beginning; its three bytes are missing in the sum.
    whole = splits.groupBy(F.col("lane").alias("_of")).agg((F.max("_size") - F.sum("_bytes")).alias("_over"))
    lines = rows.join(counted, (F.col("lane") == F.col("_lane")) & (F.col("split") == F.col("_split"))).join(whole, F.col("lane") == F.col("_of"))
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    marked = (number == 1) & (F.col("_over") >= 2)
    lines = lines.select("lane", number.cast("long").alias("line_no"), F.when(marked, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")).alias("raw"))
    return lines, whole.filter(F.col("_over").isin(-1, 2)).select(F.col("_of").alias("lane"))


def newest_snapshot(files: DataFrame, case: str = "case_id", name: str = "file_name") -> DataFrame:
    """The rows of each case's newest snapshot: names carry the time, so the greatest name is the newest."""
    newest = files.groupBy(case).agg(F.max(name).alias("_newest"))
    return files.join(newest.withColumnRenamed(case, "_case"), (F.col(case) == F.col("_case")) & (F.col(name) == F.col("_newest"))).drop("_case", "_newest")


#: The first bytes of video files, in hexadecimal, and where they stand.
MAGIC = (("66747970", 4), ("00000001", 0), ("000001", 0), ("52494646", 0), ("494D4B48", 0), ("44484156", 0))
MAGIC_BYTES = 12


@F.pandas_udf(BinaryType())
def first_bytes(paths: pd.Series) -> pd.Series:
    """The first 12 bytes of each file; null for a null path and a file that can't be read."""

    def of(path: str | None) -> bytes | None:
        if path is None:
            return None
        try:
            system, name = opened(path)
            with system.open_input_file(name) as f:
                return f.read(MAGIC_BYTES)
        except OSError:
            return None

    return paths.map(of)


@F.pandas_udf(StringType())
def file_sha256(paths: pd.Series) -> pd.Series:
    """The SHA-256 of each file, read in pieces, whatever its size; null if it can't be read."""

    def of(path: str) -> str | None:
        digest = hashlib.sha256()
        try:
            system, name = opened(path)
            with system.open_input_file(name) as f:
                while piece := f.read(1 << 23):
                    digest.update(piece)
        except OSError:
            return None
        return digest.hexdigest()

    return paths.map(of)


def catalog_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = VIDEO_EXTENSIONS, max_depth: int | None = None, with_hash: bool = False, sniff: bool = True, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, coverage) of the candidates below a folder.

    files: source_path, relative_path, extension, size_bytes, modified_unix, sha256, hash_status.
    Candidates have a listed extension or, with `sniff`, a video's first bytes. Folders named in
    `excluded` and files deeper than `max_depth` are left out. coverage counts files, listed,
    by_first_bytes, too_deep, in_excluded, other and unreadable ones. A file is opened only to
    sniff or hash it, and read in pieces.
    """
    f = reachable(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^file:/+", "/")
    rel = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    f = f.withColumns({"source_path": path, "relative_path": rel, "extension": F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))})
    parts = F.split("relative_path", "/")
    deep = F.size(parts) > max_depth if max_depth is not None else F.lit(False)
    out = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, excluded))) if excluded else F.lit(False)
    listed = F.col("extension").isin(*extensions)
    f = f.withColumn("state", F.when(deep, "too_deep").when(out, "in_excluded").when(listed, "listed").otherwise("other"))
    if sniff:
        f = f.withColumn("head", first_bytes(F.when(F.col("state") == "other", F.col("path"))))
        hexed = F.hex("head")
        known = reduce(Column.__or__, [F.substr(hexed, F.lit(2 * at + 1), F.lit(len(m))) == m for m, at in MAGIC]) & (F.length("head") >= MAGIC_BYTES)
        f = f.withColumn("state", F.when(F.col("state") != "other", F.col("state")).when(F.col("head").isNull(), "unreadable").when(known, "by_first_bytes").otherwise("other"))
    coverage = f.agg(F.count("*").alias("files"), *[F.count_if(F.col("state") == s).alias(s) for s in ("listed", "by_first_bytes", "too_deep", "in_excluded", "other", "unreadable")])
    found = f.filter(F.col("state").isin("listed", "by_first_bytes"))
    sha = file_sha256("path") if with_hash else F.lit(None).cast("string")
    found = found.withColumn("sha256", sha)
    status = F.when(F.col("sha256").isNotNull(), "hashed").otherwise("failed" if with_hash else "not-computed")
    return found.select("source_path", "relative_path", "extension", F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("modified_unix"), "sha256", status.alias("hash_status")), coverage
