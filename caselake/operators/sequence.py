"""Sequences: gaps, regressions, junctions, runs, duplicates, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .scans import long_keys, running

#: A step back is a regression; a step of more than this is a gap.
CATALOG_GAP_SECONDS = 7 * 86400
FRAME_GAP_SECONDS = 2


def timestamp_findings(catalog: DataFrame, gap: int = CATALOG_GAP_SECONDS) -> DataFrame:
    """parent_dir, id, kind (regression, gap), delta: mtimes along the paths of a folder. Rows without a time take no part."""
    w = Window.partitionBy("parent_dir").orderBy("source_path", "id")
    d = catalog.filter("modified_unix > 0").withColumn("delta", F.col("modified_unix") - F.lag("modified_unix").over(w))
    kind = F.when(F.col("delta") < 0, "regression").when(F.col("delta") > gap, "gap")
    return d.withColumn("kind", kind).filter("kind is not null").select("parent_dir", "id", "kind", "delta")


def frame_gap_findings(frames: DataFrame, gap: int = FRAME_GAP_SECONDS) -> DataFrame:
    """file, channel, offset, kind (regression, gap, invalid-date), delta along a channel's frames. An invalid date is a finding of its own, and the next frame is compared with nothing."""
    w = Window.partitionBy("file", "channel").orderBy("offset")
    d = frames.withColumn("delta", F.col("seconds") - F.lag("seconds").over(w))
    kind = F.when(F.col("seconds").isNull(), "invalid-date").when(F.col("delta") < 0, "regression").when(F.col("delta") > gap, "gap")
    return d.withColumn("kind", kind).filter("kind is not null").select("file", "channel", "offset", "kind", "delta")


def order_basis(segments: DataFrame, group: str = "group") -> DataFrame:
    """`segments` (name_s, created_s, natural) with basis and order_s: the name's time if all of a group have one, else the creation time if all have one, else the natural order of names."""
    w = Window.partitionBy(group)
    basis = F.when(F.bool_and(F.col("name_s").isNotNull()).over(w), "name").when(F.bool_and(F.col("created_s").isNotNull()).over(w), "created").otherwise("natural")
    s = segments.withColumn("basis", basis)
    return s.withColumn("order_s", F.when(F.col("basis") == "name", F.col("name_s")).when(F.col("basis") == "created", F.col("created_s")))


def junctions(segments: DataFrame, tolerance: float = 60.0, group: str = "camera") -> DataFrame:
    """group, id, next_id, delta_s, state: how a segment (start_s, duration_s) meets the next one: continuous, gap, overlap, unknown, or last."""
    w = Window.partitionBy(group).orderBy("start_s", "id")
    s = segments.withColumns({"next_id": F.lead("id").over(w), "next_start": F.lead("start_s").over(w)})
    s = s.withColumn("delta_s", F.round(F.col("next_start") - (F.col("start_s") + F.col("duration_s")), 3))
    state = F.when(F.col("next_id").isNull(), "last").when(F.col("delta_s").isNull(), "unknown").when(F.abs("delta_s") <= tolerance + 1e-9, "continuous").when(F.col("delta_s") > 0, "gap").otherwise("overlap")
    return s.select(group, "id", "next_id", "delta_s", state.alias("state"))


def running_offset(segments: DataFrame, group: str = "camera") -> DataFrame:
    """group, id, offset_s: where a segment starts in the joined output."""
    w = Window.partitionBy(group).orderBy("start_s", "id").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select(group, "id", F.round(F.coalesce(F.sum("duration_s").over(w), F.lit(0.0)), 3).alias("offset_s"))


def junction_totals(joined: DataFrame, segments: DataFrame, group: str = "camera") -> DataFrame:
    """Per group: segments, duration_s, gaps, gap_s, max_gap_s, overlaps, overlap_s, continuous, unknown."""
    d = F.abs("delta_s")
    is_ = lambda s: F.col("state") == s
    j = joined.groupBy(group).agg(
        F.count("*").alias("segments"),
        F.count_if(is_("gap")).alias("gaps"),
        F.round(F.coalesce(F.sum(F.when(is_("gap"), d)), F.lit(0.0)), 3).alias("gap_s"),
        F.max(F.when(is_("gap"), d)).alias("max_gap_s"),
        F.count_if(is_("overlap")).alias("overlaps"),
        F.round(F.coalesce(F.sum(F.when(is_("overlap"), d)), F.lit(0.0)), 3).alias("overlap_s"),
        F.count_if(is_("continuous")).alias("continuous"),
        F.count_if(is_("unknown")).alias("unknown"),
    )
    return j.join(segments.groupBy(group).agg(F.round(F.sum("duration_s"), 3).alias("duration_s")), group)


def segment_compat(segments: DataFrame, group: str = "group", fields: tuple[str, ...] = ("codec", "width", "height", "fps", "extradata")) -> DataFrame:
    """group, severity (blocking, warning), code, n: what speaks against joining a group's segments.

    Blocking: a file twice (id, path or hash), or stream parameters that differ. Warning:
    unknown duration, equal starts, mixed or unknown channels, different vendors or folders,
    audio in some only.
    """
    n = F.count("*")
    twice = lambda c: F.count(c) - F.count_distinct(c)
    checks = {
        ("blocking", "duplicate-id"): twice("id"),
        ("blocking", "duplicate-path"): twice("source_path"),
        ("blocking", "duplicate-hash"): twice("sha256"),
        **{("blocking", f"{f}-differs"): F.when(F.count_distinct(f) > 1, F.count_distinct(f)).otherwise(0) for f in fields},
        ("warning", "unknown-duration"): n - F.count("duration_s"),
        ("warning", "same-start"): twice("start_s"),
        ("warning", "mixed-channel"): F.when(F.count_distinct("channel") > 1, F.count_distinct("channel")).otherwise(0),
        ("warning", "unknown-channel"): n - F.count("channel"),
        ("warning", "vendor-differs"): F.when(F.count_distinct("vendor") > 1, F.count_distinct("vendor")).otherwise(0),
        ("warning", "folder-differs"): F.when(F.count_distinct("parent_dir") > 1, F.count_distinct("parent_dir")).otherwise(0),
        ("warning", "audio-in-some"): F.when(F.count_if("has_audio").between(1, n - 1), F.count_if("has_audio")).otherwise(0),
    }
    checks = {k: v for k, v in checks.items()}
    agg = segments.groupBy(group).agg(*[v.cast("long").alias(f"c{k}") for k, v in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(f"c{k}").alias("n")) for k, (s, c) in enumerate(checks)])
    return agg.select(group, F.explode(rows).alias("r")).select(group, "r.*").filter("n > 0")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Add `island`: a number within the keys that grows where `starts` is true along the order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def unit_runs(units: DataFrame, group: str = "image", unit: str = "unit") -> DataFrame:
    """group, first, count: runs of consecutive unit numbers; repeats count once. A group is spread over ranges of its units."""
    d = running(units.select(group, unit).distinct(), [group], unit, unit, "_before", "last")
    d = d.withColumn("_first", F.when(F.col("_before").isNull() | (F.col(unit) - F.col("_before") > 1), F.col(unit)))
    d = running(d, [group], unit, "_first", "_i", "last", inclusive=True)
    return d.groupBy(group, "_i").agg(F.min(unit).alias("first"), F.count("*").alias("count")).drop("_i")


def skipped_units(units: DataFrame, group: str = "image", unit: str = "unit") -> DataFrame:
    """group, skipped: the units that lie in holes between listed ones."""
    d = units.select(group, unit).distinct().groupBy(group).agg(F.min(unit).alias("_lo"), F.max(unit).alias("_hi"), F.count("*").alias("_n"))
    return d.select(group, (F.col("_hi") - F.col("_lo") + 1 - F.col("_n")).cast("long").alias("skipped"))


def frame_runs(units: DataFrame, least_video: int = 30, slack: int = 0) -> DataFrame:
    """image, start_b, end_b, frames, video: chains of units (start_b, end_b, is_video) where one starts at the end of the one before (up to `slack` bytes on), with enough video frames. An image's units are spread over ranges of its bytes."""
    # Places without a number stand first, as in an order of nulls.
    u = units.withColumns({"_at": F.coalesce("start_b", F.lit(-(1 << 63))), "_this": F.struct("end_b")})
    long = long_keys(units, ["image"])
    u = running(u, ["image"], "_at", "_this", "_last", "last", ("end_b", "is_video"), long=long)
    new = ~F.coalesce((F.col("start_b") - F.col("_last.end_b")).between(0, slack), F.lit(False))
    # Of equal units only the first may differ from the others, which begin runs unless they are empty.
    u = u.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("_turn", F.when(F.col("end_b") == F.col("start_b"), -F.col("_new")).otherwise(F.col("_new")))
    u = running(u, ["image"], "_at", "_new", "island", "sum", ("end_b", "is_video", "_turn"), inclusive=True, long=long)
    runs = u.groupBy("image", "island").agg(F.min("start_b").alias("start_b"), F.max("end_b").alias("end_b"), F.count("*").alias("frames"), F.count_if("is_video").alias("video"))
    return runs.filter(F.col("video") >= least_video).drop("island")


def mark_duplicates(records: DataFrame, order: list[str]) -> DataFrame:
    """`records` with duplicate_of: the first record of the same hash in the order; null for the first and for unhashed ones. The first is found by aggregation, so a hash that many rows share is no single task."""
    sha = F.nullif(F.lower("sha256"), F.lit(""))
    first = records.filter(sha.isNotNull()).groupBy(sha.alias("_sha")).agg(F.min(F.struct(*order, F.col("id").alias("_id"))).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    j = records.join(first, sha == F.col("_sha"), "left")
    return j.withColumn("duplicate_of", F.when(F.col("_first._id") != F.col("id"), F.col("_first._id"))).drop("_sha", "_first", "_n")


def compress_runs(events: DataFrame, seq: str = "seq", lane: str = "lane") -> DataFrame:
    """lane, source, kind, first_seq, last_seq, n: consecutive unaudited events of one source and kind as one row; audited ones stay single. `seq` numbers a lane's events; a lane is spread over ranges of it."""
    e = running(events.withColumn("_this", F.struct("source", "kind", "unaudited")), [lane], seq, "_this", "_last", "last")
    same = (F.col("source") == F.col("_last.source")) & (F.col("kind") == F.col("_last.kind")) & F.col("unaudited") & F.col("_last.unaudited")
    e = e.withColumn("_first", F.when(~F.coalesce(same, F.lit(False)), F.col(seq)))
    e = running(e, [lane], seq, "_first", "_island", "last", inclusive=True)
    return e.groupBy(lane, "_island").agg(F.first("source").alias("source"), F.first("kind").alias("kind"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("n")).drop("_island")


#: The high bits of a place number its range, the low ones the row in it.
PLACE_BITS = 33


def record_number(record_id: Column) -> Column:
    """The number in a record's id, by which ids are ordered: vid_1000000 comes behind vid_999999; null if it has none."""
    return F.regexp_extract(record_id, r"^vid_(\d+)$", 1).try_cast("long")


def assign_ids(new: DataFrame, existing: DataFrame, per_range: int = 500_000) -> DataFrame:
    """path_key, id: a known path keeps its id, others get the next vid_ numbers after the highest, in path order.

    Numbers have six digits at least. New paths are sorted in ranges, one for each `per_range` of
    them; a number is the place in the range behind the counts of the ranges before, so there is
    no global sort, and only the highest number comes to the driver.
    """
    known = existing.select("path_key", F.col("id").alias("_known"))
    rows = new.select("path_key").distinct().join(known, "path_key", "left")
    fresh = rows.filter("_known is null").select("path_key")
    ranged = fresh.repartitionByRange(max(1, -(-fresh.count() // per_range)), "path_key").sortWithinPartitions("path_key")
    placed = written(ranged.withColumn("_pos", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_pos", PLACE_BITS))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    top = existing.agg(F.coalesce(F.max(record_number(F.col("id"))), F.lit(0)).alias("top")).first()["top"]
    number = F.lit(top) + F.col("_before") + F.col("_pos").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    named = placed.join(counts, F.col("_range") == F.col("_r")).select("path_key", F.format_string("vid_%06d", number).alias("id"))
    return rows.filter("_known is not null").select("path_key", F.col("_known").alias("id")).unionByName(named)


def fragment_chain(packets: DataFrame) -> DataFrame:
    """image, chain, first_fragment, fragments, start_b: transport-stream fragments in disk order, chained while every shared stream's counter goes on.

    packets: image, fragment (number in disk order), offset, pid, counter (0-15), payload.
    A fragment's first counter of a stream must follow the last one of the fragment before
    (plus 1 with payload, else equal), for at least one shared stream and against none.
    Chains of two or more fragments are returned.
    """
    ends = packets.groupBy("image", "fragment", "pid").agg(F.min("offset").alias("start"), F.min_by(F.struct("counter", "payload"), "offset").alias("head"), F.max_by("counter", "offset").alias("tail"))
    frags = packets.groupBy("image", "fragment").agg(F.min("offset").alias("start_b"))
    frags = frags.withColumn("prev", F.lag("fragment").over(Window.partitionBy("image").orderBy("fragment")))
    head = ends.select("image", "fragment", "pid", "head")
    tail = ends.select("image", F.col("fragment").alias("prev"), "pid", "tail")
    shared = frags.join(head, ["image", "fragment"]).join(tail, ["image", "prev", "pid"])
    goes_on = F.col("head.counter") == (F.col("tail") + F.when(F.col("head.payload"), 1).otherwise(0)) % 16
    links = shared.groupBy("image", "fragment").agg(F.bool_and(goes_on).alias("linked"))
    f = frags.join(links, ["image", "fragment"], "left")
    f = islands(f, ["image"], ["fragment"], ~F.coalesce("linked", F.lit(False)))
    out = f.groupBy("image", F.col("island").alias("chain")).agg(F.min("fragment").alias("first_fragment"), F.count("*").alias("fragments"), F.min("start_b").alias("start_b"))
    return out.filter("fragments >= 2")


def _default(df: DataFrame, name: str, value: bool) -> Column:
    return F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)


def _packed(digest: Column) -> Column:
    """A hash in few bytes, different for different ones: 64 lower-case hexadecimal digits as 32 bytes, others behind 33 bytes of zero."""
    return F.when(digest.rlike("^[0-9a-f]{64}\\z"), F.unhex(digest)).otherwise(F.concat(F.unhex(F.lit("00" * 33)), F.encode(digest, "UTF-8")))


def verify_concat(sources: DataFrame, output: DataFrame, audio: DataFrame | None = None, audio_out: DataFrame | None = None) -> DataFrame:
    """group, mode, packets_ok, hashes_ok, starts_ok, audio_ok, verdict of a lossless join.

    sources: group, segment, seq, pts, is_key, hash (of the payload without framing and
    parameter sets), duration_s (of its segment) and, if some of a segment's packets are hidden by
    its edit list, discard; output: group, seq, pts, hash and, if known, is_key, discard. audio
    (group, segment, packets) and audio_out (group, packets) count sound.

    mode is all-packets, where every packet must come again in order with its hash; or
    edit-list-applied, where the output has exactly as many packets as the sources show. As an
    output that kept hidden packets and lost others has that number too, each segment with hidden
    packets must then show its own: the hashes of packets that are no key frames, in order, or
    of all, if all that it shows are key frames (else a key frame may be rewritten). Each
    segment must start where those before end, with what they show too much, to a second or 0.2
    hundredths; sound may differ by a packet for each segment.
    """
    s = sources.select("group", "segment", "seq", _packed(F.col("hash")).alias("_hash"), F.coalesce("is_key", F.lit(False)).alias("_key"), _default(sources, "discard", False).alias("_hidden"), "duration_s")
    o = output.select("group", F.col("seq").alias("_place"), F.col("pts").alias("_pts"), _packed(F.col("hash")).alias("_seen"), _default(output, "is_key", True).alias("_okey"), _default(output, "discard", False).alias("_ohidden"))
    segments = s.groupBy("group", "segment").agg(F.count("*").alias("total"), F.count_if(~F.col("_hidden")).alias("kept"), F.count_if(~F.col("_hidden") & ~F.col("_key")).alias("plain"), F.max("duration_s").alias("d"))
    segments = written(segments)
    counts = segments.groupBy("group").agg(F.sum("total").alias("all"), F.sum("kept").alias("shown"), F.count("*").alias("segments")).join(o.groupBy("group").agg(F.count("*").alias("observed")), "group", "full_outer")
    counts = counts.withColumn("observed", F.coalesce("observed", F.lit(0))).withColumn("maybe", F.coalesce((F.col("observed") != F.col("all")) & (F.col("observed") == F.col("shown")), F.lit(False)))
    counts = written(counts)

    # Packets of both sides are dealt by group once; all that follows up to a row per segment stays there. Way 0 counts all packets of the sources, way 1 the shown ones.
    both = s.drop("duration_s").withColumn("_side", F.lit(0)).unionByName(o.withColumn("_side", F.lit(1)), allowMissingColumns=True).repartition("group")
    along = Window.partitionBy("group", "_side").orderBy("segment", "seq", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"_all": F.count("*").over(along), "_shown": F.count_if(~F.col("_hidden")).over(along)})
    both = both.join(counts.select("group", "maybe"), "group", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
    other = F.when(F.col("_side") == 1, F.col("_all")).when(~F.col("_hidden"), F.col("_shown"))
    spot = lambda way, pos: F.struct(F.lit(way).alias("way"), pos.alias("pos"))
    both = both.withColumn("_at", F.explode(F.array_compact(F.array(spot(0, F.col("_all")), F.when(F.col("maybe") & other.isNotNull(), spot(1, other))))))
    met = both.groupBy("group", F.col("_at.way").alias("way"), F.col("_at.pos").alias("pos")).agg(*[F.max(c).alias(c) for c in ("segment", "_hash", "_key", "_hidden", "_seen", "_pts", "_okey", "_ohidden")])
    up_to = Window.partitionBy("group", "way", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumns({"_n": F.count_if(~F.col("_key")).over(up_to), "_on": F.count_if(~F.col("_okey")).over(up_to)})
    nothing = F.lit(None).cast("binary")
    item = lambda n, wanted, got: F.struct(F.col(n).alias("n") if n else F.lit(0).cast("long").alias("n"), wanted.alias("wanted"), got.alias("got"))
    shown = F.col("way") == 1
    met = met.withColumn("_i", F.explode(F.array_compact(F.array(item(None, nothing, nothing), F.when(shown & ~F.col("_key"), item("_n", F.col("_hash"), nothing)), F.when(shown & ~F.col("_okey"), item("_on", nothing, F.col("_seen")))))))
    same = F.coalesce(F.col("_hash") == F.col("_seen"), F.lit(False))
    visible = ~F.col("_ohidden")
    met = met.groupBy("group", "way", "segment", F.col("_i.n").alias("n")).agg(
        F.max("_i.wanted").alias("wanted"), F.max("_i.got").alias("got"), F.bool_and(same).alias("same"), F.bool_and(same & F.coalesce("_okey", F.lit(False))).alias("whole"),
        F.min(F.when(visible, F.col("_pts"))).alias("first"), F.min(F.when(visible & ~F.col("_hidden"), F.col("_pts"))).alias("own"),
    )
    part = F.when(F.col("n") > 0, F.coalesce(F.col("wanted") == F.col("got"), F.lit(False)))
    met = written(met.groupBy("group", "way", "segment").agg(F.bool_and(F.when(F.col("n") == 0, F.col("same"))).alias("same"), F.bool_and(F.when(F.col("n") == 0, F.col("whole"))).alias("whole"), F.bool_and(part).alias("parts"), F.min("first").alias("first"), F.min("own").alias("own")))

    tested = met.filter("way = 1").join(segments.filter("kept < total and kept > 0").select("group", "segment", "plain"), ["group", "segment"])
    confirmed = tested.groupBy("group").agg(F.bool_and(F.when(F.col("plain") == 0, F.col("whole")).otherwise(F.col("parts"))).alias("confirmed"))
    modes = counts.join(confirmed, "group", "left").withColumn("applied", F.col("maybe") & F.coalesce("confirmed", F.lit(True)))

    m = met.join(modes.select("group", "applied"), "group").filter(F.col("way") == F.col("applied").cast("int"))
    hashes = m.groupBy("group").agg(F.bool_and(F.col("applied") | F.col("same")).alias("hashes_ok"))
    starts = m.filter("segment is not null").select("group", "segment", "first", "own")
    starts = segments.select("group", "segment", "d").join(starts, ["group", "segment"], "left").withColumn("more", F.greatest(F.coalesce(F.col("own") - F.col("first"), F.lit(0.0)), F.lit(0.0)))
    along = Window.partitionBy("group").orderBy("segment")
    expected = F.coalesce(F.sum(F.col("d") + F.col("more")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = starts.withColumns({"expected": expected, "observed": F.col("first") - F.coalesce(F.first("first").over(along), F.lit(0.0))})
    near = F.abs(F.col("observed") - F.col("expected")) <= F.greatest(F.col("expected") * 0.002, F.lit(1.0))
    starts = starts.groupBy("group").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("starts_ok"))

    out = modes.join(hashes, "group", "left").join(starts, "group", "left")
    if audio is None:
        out = out.withColumn("audio_ok", F.lit(True))
    else:
        want = segments.select("group", "segment").join(audio, ["group", "segment"], "left").groupBy("group").agg(F.when(F.bool_and(F.col("packets").isNotNull()), F.sum("packets")).alias("_want"))
        heard = audio_out.groupBy("group").agg(F.sum("packets").alias("_heard")) if audio_out is not None else want.select("group", F.lit(None).cast("long").alias("_heard"))
        ok = F.col("_want").isNull() | F.coalesce(F.abs(F.col("_want") - F.col("_heard")) <= F.col("segments"), F.lit(False))
        out = out.join(want, "group", "left").join(heard, "group", "left").withColumn("audio_ok", ok)
    packets = F.coalesce((F.col("observed") == F.col("all")) | F.col("applied"), F.lit(False))
    good = packets & F.coalesce("hashes_ok", F.lit(False)) & F.coalesce("starts_ok", F.lit(False)) & F.col("audio_ok")
    return out.select("group", F.when(F.col("applied"), "edit-list-applied").otherwise("all-packets").alias("mode"), packets.alias("packets_ok"), F.coalesce("hashes_ok", F.lit(False)).alias("hashes_ok"), F.coalesce("starts_ok", F.lit(False)).alias("starts_ok"), "audio_ok", F.when(good, "verified").otherwise("failed").alias("verdict"))
