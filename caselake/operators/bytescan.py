"""Byte-level scans over chunks of images: signatures, declared lengths, frames, location sentences.

Chunks are (image, start_b, bytes) rows as `sources.chunks` reads them, each with some
bytes of the one before (752 at least), so that a pattern across a border is seen whole;
rows found twice become one. Scans cut chunks into such pieces again.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .intervals import merged, points_in
from .scans import greedy_chain, long_keys, parted

#: Byte patterns that begin a file or stream, by signature, and how far before the match it begins.
SIGNATURES = (
    ("mp4-ftyp", rb"ftyp", 4),
    ("riff-avi", rb"RIFF(?=....AVI)", 0),
    ("dahua-dhav", rb"DHAV", 0),
    ("hikvision-imkh", rb"IMKH", 0),
    ("jpeg", rb"\xff\xd8\xff", 0),
    ("mpeg-ps", rb"\x00\x00\x01\xba(?=[\x21\x44])", 0),
    ("ebml-mkv", rb"\x1a\x45\xdf\xa3", 0),
)
TRANSPORT = "mpegts-sync"
#: The unit type behind a four-byte start code that begins an elementary stream.
ANNEX_B = {0x67: "h264-annexb", 0x40: "h265-annexb", 0x42: "h265-annexb"}
#: Signatures of files with a header of their own: kept inside a container. All others are a container's payload there.
CONTAINERS = ("mp4-ftyp", "riff-avi", "dahua-dhav", "hikvision-imkh", "ebml-mkv")
TS_PACKET, TS_SYNC = 188, 0x47
START_CODE = b"\x00\x00\x00\x01"
ANNEX_B_REACH = 512
#: Scans see a chunk in pieces of so many bytes, each with as many of the piece before as chunks have of the chunk before.
PIECE, OVERLAP = 4096, 752


def _pieces(chunks: DataFrame) -> DataFrame:
    """The chunks (image, start_b, bytes) cut into pieces of `PIECE` + `OVERLAP` bytes at most, so that what a scan holds at once (a batch of rows) has a bound, however large chunks are."""
    ends = F.sequence(F.lit(0), F.greatest(F.octet_length("bytes") - 1, F.lit(0)), F.lit(PIECE))

    def piece(at: Column) -> Column:
        start = F.greatest(at - OVERLAP, F.lit(0))
        return F.struct((F.col("start_b") + start).alias("start_b"), F.substring("bytes", start + 1, at + PIECE - start).alias("bytes"))

    return chunks.select("image", F.explode(F.transform(ends, piece)).alias("_piece")).select("image", "_piece.*")


def _syncs(data: np.ndarray, start: int) -> np.ndarray:
    """Where runs of transport packets begin: four syncs a packet apart, and none a packet before."""
    n = len(data) - 3 * TS_PACKET
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    sync = data == TS_SYNC
    run = sync[:n] & sync[TS_PACKET : n + TS_PACKET] & sync[2 * TS_PACKET : n + 2 * TS_PACKET] & sync[3 * TS_PACKET :]
    run[TS_PACKET:] &= ~sync[: max(0, n - TS_PACKET)]
    run[:TS_PACKET] &= start == 0
    return np.flatnonzero(run)


def _hits(data: bytes, start: int) -> Iterator[tuple[int, str, int | None, int | None]]:
    """(place, signature, declared length, claimed span) of what begins in a chunk."""
    for name, pattern, back in SIGNATURES:
        for m in re.finditer(b"(?s)" + pattern, data):
            if m.start() < back:
                continue
            declared = claim = None
            if name == "riff-avi" and data[m.start() + 8 : m.start() + 12] == b"AVI ":
                size = struct.unpack_from("<I", data, m.start() + 4)[0]
                declared, claim = size + 8 if size >= 12 else None, size if size > 8 else None
            yield m.start() - back, name, declared, claim
    for at in _syncs(np.frombuffer(data, dtype=np.uint8), start).tolist():
        yield at, TRANSPORT, None, None
    at = data.find(START_CODE)
    while at >= 0:
        name = ANNEX_B.get(data[at + 4]) if at + 4 < len(data) else None
        if name and data.find(START_CODE, at + 5, at + 5 + ANNEX_B_REACH) >= 0:
            yield at, name, None, None
        at = data.find(START_CODE, at + 1)


def scan_signatures(chunks: DataFrame) -> DataFrame:
    """image, offset, signature, declared, claim: where files and streams begin, one at each place.

    A RIFF's declared length is its size field and 8; a size below 12 declares nothing. Its
    claim is a size above 8, what `suppress_nested` takes as its span; both need `AVI` with a
    blank. Four-byte start codes count, with a parameter set behind and another start code in 512
    bytes. Where a file type box and another signature begin at one place, the other counts.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s + at, *rest) for i, s, data in zip(batch["image"], batch["start_b"], batch["bytes"], strict=True) for at, *rest in _hits(bytes(data), s)]
            out = pd.DataFrame(rows, columns=["image", "offset", "signature", "declared", "claim"])
            yield out.astype({"declared": "Int64", "claim": "Int64"})

    found = _pieces(chunks).mapInPandas(scan, "image string, offset long, signature string, declared long, claim long")
    first = F.min(F.struct((F.col("signature") == "mp4-ftyp").alias("late"), "signature"))
    return found.groupBy("image", "offset").agg(first["signature"].alias("signature"), F.max("declared").alias("declared"), F.max("claim").alias("claim"))


SPAN_CAP = 1 << 30


def suppress_nested(hits: DataFrame, cap: int = SPAN_CAP, size: int = 1 << 24, short: int | None = None) -> DataFrame:
    """`hits` (image, offset, signature, claim, ...) with nested_in: the RIFF file in whose span a hit lies.

    A RIFF file with a claim that lies in no open span opens one, up to its claim (`cap` at
    most) and the 8 bytes of its header. Inside it files with a header of their own stay, with
    nested_in; pictures and streams go. Which files open spans depends on those before: a
    greedy chain. Images of `short` hits at most (as in `scans`) are walked along sorted hits, many
    in a task, and the walk holds one span; in longer ones the chain's spans meet the hits in a
    range join. Hits are worked out once, as both the count and the walk read them.
    """
    # A file type box is met four bytes behind its file's beginning.
    met = F.col("offset") + F.when(F.col("signature") == "mp4-ftyp", 4).otherwise(0)
    until = F.when((F.col("signature") == "riff-avi") & F.col("claim").isNotNull(), F.col("offset") + 8 + F.least("claim", F.lit(cap)))
    seen = written(hits.withColumns({"_met": met.cast("long"), "_until": until.cast("long")}))
    few, many = parted(seen, ["image"], long_keys(seen, ["image"], short))
    j = _walked_spans(few)
    if many is not None:
        j = j.unionByName(_joined_spans(many, size))
    return j.filter(F.col("nested_in").isNull() | F.col("signature").isin(*CONTAINERS)).select(*hits.columns, "nested_in")


def _walked_spans(seen: DataFrame) -> DataFrame:
    """`seen` with nested_in. At one place the longest claim comes first; a span begins behind its own place, so that the order of the others there does not matter."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, lo, hi = None, 0, 0
        for batch in batches:
            n, images = batch.num_rows, batch.column("image")
            if n == 0:
                continue
            # A null image is in no span.
            new = np.ones(n, dtype=bool)
            new[0] = image is None or images[0].as_py() != image
            new[1:] = pc.fill_null(pc.not_equal(images.slice(1), images.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            number = np.cumsum(new)
            met = pc.fill_null(batch.column("_met"), 0).to_numpy(zero_copy_only=False)
            riff = np.flatnonzero(batch.column("_until").is_valid().to_numpy(zero_copy_only=False))
            ends = batch.column("_until").take(pa.array(riff)).to_numpy(zero_copy_only=False).tolist()
            # Spans that open in this batch, behind the one that the batch before left open in image 0.
            at, los, his, owners, owner, end = [-1], [lo], [hi], [0], 0, hi
            for i, place, mine, to in zip(riff.tolist(), met[riff].tolist(), number[riff].tolist(), ends, strict=True):
                if mine != owner or place >= end:
                    owner, end = mine, to
                    at.append(i)
                    los.append(place)
                    his.append(to)
                    owners.append(mine)
            last = np.searchsorted(np.array(at), np.arange(n), side="right") - 1
            begin = np.array(los, dtype=np.int64)[last]
            inside = (np.array(owners)[last] == number) & (met > begin) & (met < np.array(his, dtype=np.int64)[last])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin, mask=~inside)], names=[*batch.schema.names, "nested_in"])
            image = images[n - 1].as_py()
            lo, hi = (los[-1], his[-1]) if owners[-1] == number[-1] else (0, 0)

    schema = seen.withColumn("nested_in", F.lit(None).cast("long")).schema
    return seen.repartition("image").sortWithinPartitions("image", "_met", F.desc_nulls_last("_until")).mapInArrow(walk, schema)


def _joined_spans(seen: DataFrame, size: int) -> DataFrame:
    riff = seen.filter("_until is not null").groupBy("image", F.col("_met").alias("lo")).agg(F.max("_until").alias("hi"))
    spans = greedy_chain(riff, ["image"], "lo", "hi")
    places = seen.select("image", "offset", "signature", "_met")
    inner = points_in(places, spans, ["image"], "_met", "lo", "hi", size).filter("_met > _r_lo").groupBy("image", "offset", "signature").agg(F.max("_r_lo").alias("nested_in"))
    return seen.join(inner, ["image", "offset", "signature"], "left")


ANCHOR_STEP = 4 << 20


def thin_anchors(hits: DataFrame, step: int = ANCHOR_STEP) -> DataFrame:
    """Hits in which an image's elementary-stream anchors, H.264 and H.265 as one series, keep `step` bytes from the last one kept; all other hits stay."""
    anchor = F.col("signature").isin(*set(ANNEX_B.values()))
    places = hits.filter(anchor).select("image", "offset").distinct()
    kept = greedy_chain(places.withColumn("until", F.col("offset") + step), ["image"], "offset", "until").select("image", "offset").withColumn("_kept", F.lit(True))
    return hits.join(kept, ["image", "offset"], "left").filter(~anchor | F.col("_kept")).select(*hits.columns)


LEAST_PACKETS = 4


def _sync_runs(data: np.ndarray, start: int) -> np.ndarray:
    """(first, end) of the runs of syncs a packet apart in one chunk; short ones only where the chunk's border may hide more of them."""
    at = np.flatnonzero(data == TS_SYNC)
    at = at[np.lexsort((at, (at + start) % TS_PACKET))]
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.diff(at) != TS_PACKET
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
    keep = (last - first >= (LEAST_PACKETS - 1) * TS_PACKET) | (first < TS_PACKET) | (last + TS_PACKET >= len(data))
    return np.stack([first[keep] + start, last[keep] + start + TS_PACKET], axis=1)


def ts_runs(chunks: DataFrame) -> DataFrame:
    """image, start_b, end_b, packets: runs of four transport-stream packets or more, from each start to the first desync.

    A chunk gives one row for each run in it, and the pieces that touch its borders; pieces of
    one phase that touch or overlap are one run. So rows are as many as runs, not as packets.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(image, a, b, a % TS_PACKET) for image, start, data in zip(batch["image"], batch["start_b"], batch["bytes"], strict=True) for a, b in _sync_runs(np.frombuffer(bytes(data), dtype=np.uint8), start).tolist()]
            yield pd.DataFrame(rows, columns=["image", "start_b", "end_b", "phase"])

    found = _pieces(chunks).mapInPandas(pieces, "image string, start_b long, end_b long, phase long")
    runs = merged(found, ["image", "phase"]).withColumn("packets", F.expr(f"(end_b - start_b) div {TS_PACKET}"))
    return runs.filter(F.col("packets") >= LEAST_PACKETS).select("image", "start_b", "end_b", "packets")


#: A sentence ends at a line's end, or after 200 bytes.
SENTENCE_HEAD = r"\$G[^\r\n](?:RMC|GGA),"
SENTENCE = SENTENCE_HEAD + r"[^\r\n]{0,193}"


def track_points(chunks: DataFrame) -> DataFrame:
    """image, offset, lat, lon, day, time_s, speed_kmh, alt_m of location sentences anywhere in the bytes.

    An RMC sentence counts only with status A; minutes of 60 or more make none, and only S and
    W turn the sign. A sentence that a chunk cuts is seen whole in the next one (the longest of
    an offset counts). Years from 80 on are of the 20th century.
    """

    # One sign for each byte; parts of a piece begin where sentences do, and a sentence may reach over the next one's beginning.
    s = _pieces(chunks).select("image", "start_b", F.decode("bytes", "ISO-8859-1").alias("piece")).filter(F.contains("piece", F.lit("$G")))
    lengths = F.transform(F.split("piece", f"(?={SENTENCE_HEAD})", -1), F.length)
    s = s.withColumn("places", F.aggregate(lengths, F.array(F.lit(0)), lambda places, n: F.concat(places, F.array(F.element_at(places, -1) + n))))
    s = s.select("image", "start_b", F.explode(F.transform("places", lambda at: F.struct(at.alias("at"), F.regexp_extract(F.substr("piece", at + 1, F.lit(200)), f"^{SENTENCE}", 0).alias("text")))).alias("m"))
    s = s.filter("m.text <> ''").select("image", (F.col("start_b") + F.col("m.at")).alias("offset"), F.regexp_replace("m.text", r"[^\x00-\x7F]", "\ufffd").alias("text"))
    s = s.groupBy("image", "offset").agg(F.max_by("text", F.length("text")).alias("text"))
    f = F.split(F.regexp_replace("text", r"(?s)\*.*$", ""), ",")
    s = s.withColumn("f", f).withColumn("rmc", F.substring(f[0], 4, 3) == "RMC")
    at = lambda rmc, gga: F.when(F.col("rmc"), F.get("f", F.lit(rmc))).otherwise(F.get("f", F.lit(gga)))

    def angle(value, side, minus: str):
        number = value.try_cast("double")
        degrees = F.floor(number / 100)
        minutes = number - degrees * 100
        return F.when((number >= 0) & (minutes < 60), F.when(side == minus, -1.0).otherwise(1.0) * (degrees + minutes / 60))

    t = at(1, 1)
    seconds = F.substring(t, 1, 2).try_cast("long") * 3600 + F.substring(t, 3, 2).try_cast("long") * 60 + F.substring(t, 5, 2).try_cast("long")
    day = F.when(F.col("rmc") & (F.length(F.get("f", F.lit(9))) == 6), F.concat(F.when(F.substring(F.get("f", F.lit(9)), 5, 2) >= "80", "19").otherwise("20"), F.substring(F.get("f", F.lit(9)), 5, 2), F.lit("-"), F.substring(F.get("f", F.lit(9)), 3, 2), F.lit("-"), F.substring(F.get("f", F.lit(9)), 1, 2)))
    out = s.filter(~F.col("rmc") | (F.get("f", F.lit(2)) == "A")).select(
        "image", "offset",
        angle(at(3, 2), at(4, 3), "S").alias("lat"), angle(at(5, 4), at(6, 5), "W").alias("lon"),
        day.alias("day"), seconds.alias("time_s"),
        F.when(F.col("rmc"), F.get("f", F.lit(7)).try_cast("double") * 1.852).alias("speed_kmh"), F.when(~F.col("rmc"), F.get("f", F.lit(9)).try_cast("double")).alias("alt_m"),
    )
    return out.filter("lat is not null and lon is not null and abs(lat) <= 90 and abs(lon) <= 180")


#: Layout of a frame header of the DHAV format.
FRAME_HEADER = "<4sBBBBIIIHBB"
FRAME_HEADER_SIZE = struct.calcsize(FRAME_HEADER)
VIDEO_TYPES = (0xFC, 0xFD)
AUDIO_TYPES = (0xF0,)


def frame_headers(chunks: DataFrame) -> DataFrame:
    """image, offset, type, channel, packed_date, counter, length, is_video of frame headers found by their magic; lengths that cannot hold header and footer are none."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image, start, data in zip(batch["image"], batch["start_b"], batch["bytes"], strict=True):
                data = bytes(data)
                for m in re.finditer(b"DHAV", data):
                    if m.start() + FRAME_HEADER_SIZE <= len(data):
                        _, kind, _, channel, _, _, length, date, counter, _, _ = struct.unpack_from(FRAME_HEADER, data, m.start())
                        if length >= FRAME_HEADER_SIZE + 8 and length < 1 << 26:
                            rows.append((image, start + m.start(), kind, channel, date, counter, length, kind in VIDEO_TYPES))
            yield pd.DataFrame(rows, columns=["image", "offset", "type", "channel", "packed_date", "counter", "length", "is_video"])

    return _pieces(chunks).mapInPandas(headers, "image string, offset long, type int, channel int, packed_date long, counter int, length long, is_video boolean").distinct()


#: The largest chunk of the AVI format that counts, and the video frames that a run needs.
MOST_AVI_CHUNK = 8 << 20
LEAST_VIDEO = 30
#: Stream chunks by their ids (two digits and a kind), and chunks that go on a chain without beginning one.
AVI_CHUNK = rb"(?s)(?=((?:[0-9]{2}(?:dc|db|wb))|ix[0-9].|JUNK)(.{4}))"
RUN_KINDS = {"avi": "avi-frames", "dhav": "dhav-frames"}
UNITS = "image string, kind string, start_b long, end_b long, is_video boolean, begins boolean"


def _units(data: bytes, start: int) -> Iterator[tuple[str, int, int, bool, bool]]:
    for m in re.finditer(AVI_CHUNK, data):
        name, size = m.group(1), int.from_bytes(m.group(2), "little")
        if 0 < size <= MOST_AVI_CHUNK:
            stream = name[:2].isdigit()
            yield RUN_KINDS["avi"], start + m.start(), start + m.start() + 8 + size + size % 2, stream and name[2:3] == b"d", stream
    for m in re.finditer(b"DHAV", data):
        if m.start() + FRAME_HEADER_SIZE <= len(data):
            kind, length = data[m.start() + 4], int.from_bytes(data[m.start() + 12 : m.start() + 16], "little")
            if FRAME_HEADER_SIZE + 8 <= length < 1 << 26:
                yield RUN_KINDS["dhav"], start + m.start(), start + m.start() + length, kind in VIDEO_TYPES, True


def frame_units(chunks: DataFrame) -> DataFrame:
    """image, kind, start_b, end_b, is_video, begins: whatever reads as a unit of a container that states its own size, at any place: AVI stream, index and padding chunks, DHAV frames. begins: it may begin a chain."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *unit) for i, s, data in zip(batch["image"], batch["start_b"], batch["bytes"], strict=True) for unit in _units(bytes(data), s)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")])

    return _pieces(chunks).mapInPandas(parse, UNITS).distinct()


def unit_chains(units: DataFrame, short: int | None = None) -> DataFrame:
    """image, kind, start_b, begins, end_b, units, video: from each unit on, how far the chain goes in which each unit starts where the one before ends.

    Where an image has `short` units of a kind at most (as in `scans`), one walk over its units from the last to
    the first tells all chains, many images in a task. In others pointers are jumped: a unit
    knows what it reaches in 2, 4, 8 ... steps, with the sums along them; a chain of n units
    takes about log2(n) rounds, whatever image it is in.
    """
    keys = ["image", "kind"]
    state = units.groupBy(*keys, "start_b").agg(F.max("end_b").alias("end_b"), F.max("is_video").cast("long").alias("video"), F.max("begins").alias("begins")).withColumn("units", F.lit(1).cast("long"))
    state = written(state)
    few, many = parted(state, keys, long_keys(state, keys, short))
    columns = [*keys, "start_b", "begins", "end_b", "units", "video"]

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, reached = None, {}
        for batch in batches:
            ends, counts, videos = [], [], []
            for image, kind, start, end, video in zip(*(batch[c].tolist() for c in (*keys, "start_b", "end_b", "video")), strict=True):
                if (image, kind) != here:
                    here, reached = (image, kind), {}
                last, n, seen = reached.get(end, (end, 0, 0))
                reached[start] = last, n + 1, seen + video
                ends.append(last)
                counts.append(n + 1)
                videos.append(seen + video)
            yield batch.assign(end_b=ends, units=counts, video=videos)[columns]

    schema = few.select(*columns).schema
    walked = few.repartition(*keys).sortWithinPartitions(*keys, F.desc("start_b")).mapInPandas(back, schema)
    return walked if many is None else walked.unionByName(_jumped(many))


def _jumped(state: DataFrame) -> DataFrame:
    keys, more = ["image", "kind"], True
    while more:
        there = state.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "start_b", "end_b", "units", "video")])
        on = (F.col("image") == F.col("_image")) & (F.col("kind") == F.col("_kind")) & (F.col("end_b") == F.col("_start_b"))
        add = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        step = written(state.join(there, on, "left").select(*keys, "start_b", "begins", F.coalesce("_end_b", "end_b").alias("end_b"), add("units"), add("video"), F.col("_start_b").isNotNull().alias("_moved")))
        more = not step.filter("_moved").isEmpty()
        state = step.drop("_moved")
    return state.select(*keys, "start_b", "begins", "end_b", "units", "video")


def frame_chains(units: DataFrame, least_video: int = LEAST_VIDEO) -> DataFrame:
    """image, kind, start_b, end_b, units, video: the runs of frames whose file header is gone.

    A search goes along the bytes. Where a unit may begin a chain and another follows it, the
    chain is followed; with `least_video` frames it is a run, and the search goes on behind
    it, else one byte on. So runs are a greedy chain over the units from which enough frames
    follow. A chain that the image's end cuts counts like any other, and the search goes on
    inside it.
    """
    chains = written(unit_chains(units).filter(F.col("begins") & (F.col("units") >= 2) & (F.col("video") >= least_video)))
    kept = greedy_chain(chains.select("image", "kind", "start_b", "end_b"), ["image", "kind"], "start_b", "end_b").select("image", "kind", "start_b")
    return chains.join(kept, ["image", "kind", "start_b"], "left_semi").select("image", "kind", "start_b", "end_b", "units", "video")
