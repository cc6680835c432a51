"""Columns that classify a record: source profile, confidence, validation, playability, grades."""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import slashed


class Rule(NamedTuple):
    """A rule fits if the extension is one of `extensions` (none: any) and the path, or only its last part, holds one of `needles` (none: any)."""

    lane: str
    vendor: str
    parser: str
    confidence: str
    extensions: tuple[str, ...]
    needles: tuple[str, ...]
    action: str
    evidence: str
    in_name: bool = False


CCTV, DASHCAM, RECOVERY = "cctv-nvr-export", "dashcam-sd-card", "dvr-hdd-recovery"
DAHUA, HANWHA, AVIGILON, GENETEC, MILESTONE = "Dahua / OEM DAV", "Hanwha/Wisenet WAVE", "Avigilon ACC", "Genetec Security Center", "Milestone XProtect"
OF_EXTENSION, OF_PATH = "proprietary extension: .{ext}", "path contains vendor signal: {needle}"
DAV_ACTION = "Preserve DAV original, then use FFmpeg or official Smart Player assisted export to MP4/AVI."
G64_ACTION = "Treat G64/G64x as proprietary export; use Genetec Video Player/Security Desk for review or conversion."
AVE_ACTION = "Treat AVE as proprietary export; preserve original and use player-assisted export when required."
#: Extensions that name their vendor, alone or under a path.
EXTENSION_RULES = (
    Rule(CCTV, DAHUA, "dahua_dav", "high", ("dav", "dav_"), (), DAV_ACTION, OF_EXTENSION),
    Rule(CCTV, HANWHA, "hanwha_wisenet_wave", "high", ("nov",), (), "Treat NOV as proprietary WAVE export; prefer official WAVE/player assisted conversion.", OF_EXTENSION),
    Rule(CCTV, AVIGILON, "avigilon_ave", "high", ("ave",), (), AVE_ACTION, OF_EXTENSION),
    Rule(CCTV, GENETEC, "genetec_g64", "high", ("g64", "g64x"), (), G64_ACTION, OF_EXTENSION),
    Rule(DASHCAM, "Garmin Dash Cam", "garmin_dashcam", "high", ("glv",), (), "Classify as Garmin low-resolution companion video; preserve alongside MP4 files.", "Garmin GLV companion video extension"),
    Rule(CCTV, MILESTONE, "milestone_xprotect", "medium", ("blk",), (), "Treat as XProtect package artifact; ingest standard media exports directly.", "XProtect-like .blk artifact extension"),
    Rule(CCTV, DAHUA, "dahua_dav", "medium", ("asf",), ("dahua", "smartpss", "dss"), "Dahua exports may arrive as ASF; preserve and transcode only into derived artifacts.", "ASF file under Dahua/SmartPSS/DSS-like path"),
    Rule(CCTV, "Axis", "axis_onvif", "medium", ("mkv",), ("axis", "vapix"), "Axis edge-storage exports are commonly playable MKV; ingest directly and preserve API/export logs.", "MKV file under Axis/VAPIX-like path"),
)


class Parser(NamedTuple):
    id: str
    lane: str
    vendor: str
    confidence: str
    path_needles: tuple[str, ...]
    extensions: tuple[str, ...]
    recommended_action: str


#: Parsers of proprietary extensions.
EXTENSION_PARSERS = (
    Parser("dahua_dav", CCTV, DAHUA, "high", ("dahua", "smartpss", "dss"), ("dav", "dav_", "asf"), DAV_ACTION),
    Parser("genetec_g64", CCTV, GENETEC, "high", ("genetec",), ("g64", "g64x"), G64_ACTION),
    Parser("avigilon_ave", CCTV, AVIGILON, "high", ("avigilon", "/acc/"), ("ave",), AVE_ACTION),
)
#: Vendors that a path names, whatever the extension, and parsers without needles, which no path names.
VENDOR_PARSERS = (
    Parser("hikvision", CCTV, "Hikvision", "medium", ("hikvision", "ivms", "vsplayer", "hikcentral"), ("mp4", "avi", "mpg", "mpeg", "ps"), "If the file starts with IMKH, run export-hik (strip 40-byte header + remux). Prefer vendor player for encrypted/SDK exports. HDD FS recovery needs a real image corpus."),
    Parser("dahua_dav", CCTV, DAHUA, "medium", ("dahua", "smartpss", "dss"), ("dav", "asf", "mp4", "avi"), "Path signal only: use DAV/ASF detection and official player-assisted conversion when FFmpeg cannot decode."),
    Parser("blackvue", DASHCAM, "BlackVue", "medium", ("blackvue",), ("mp4",), "Path signal only: pair front/rear channels and extract GPS/G-sensor metadata when present."),
    Parser("thinkware_inavi", DASHCAM, "Thinkware / iNavi", "medium", ("thinkware", "inavi", "아이나비"), ("mp4", "avi", "mov"), "Path signal only: classify recording mode folders and extract GPS/speed metadata when present."),
    Parser("finevu", DASHCAM, "FineVu", "medium", ("finevu", "fine-vu", "mando"), ("mp4", "avi"), "Path signal only: extract player-compatible GPS/G-sensor metadata when present."),
    Parser("urive", DASHCAM, "Urive", "medium", ("urive", "유라이브"), ("mp4", "avi"), "Path signal only: classify continuous/event/parking folders and preserve player metadata sidecars."),
    Parser("papago_dashcam", DASHCAM, "PAPAGO", "medium", ("papago", "gosafe"), ("mp4", "mov"), "Path signal only: extract GPS/speed metadata when present and verify front/rear pairing."),
    Parser("iroad", DASHCAM, "IROAD", "medium", ("iroad",), ("mp4", "avi"), "Path signal only: classify event folders and GPS metadata when present."),
    Parser("viofo", DASHCAM, "VIOFO", "medium", ("viofo",), ("mp4",), "Path signal only: use MP4 as primary media and extract GPS tracks when present."),
    Parser("garmin_dashcam", DASHCAM, "Garmin Dash Cam", "medium", ("garmin",), ("mp4", "glv"), "Path signal only: preserve DCIM layout, MP4 files, and GLV companion files."),
    Parser("nextbase", DASHCAM, "Nextbase", "medium", ("nextbase",), ("mp4",), "Path signal only: extract GPS map/G-sensor metadata when present."),
    Parser("hanwha_wisenet_wave", CCTV, HANWHA, "medium", ("hanwha", "wisenet", "/wave/"), ("nov", "mp4", "mkv", "avi"), "Path signal only: prefer WAVE official export path; ingest standard MP4/MKV/AVI outputs directly."),
    Parser("axis_onvif", CCTV, "Axis", "medium", ("axis", "vapix", "onvif"), ("mkv", "mp4", "asf"), "Path signal only: use MKV exports directly; device/API acquisition is a future connector path."),
    Parser("uniview", CCTV, "Uniview", "medium", ("uniview", "ezstation"), ("mp4", "avi"), "Path signal only: start with official export outputs; add proprietary samples later."),
    Parser("idis", CCTV, "IDIS", "medium", ("idis",), ("avi", "mp4"), "Path signal only: ingest AVI directly; preserve self-player exports without running them."),
    Parser("bosch_bvms", CCTV, "Bosch BVMS/VRM", "medium", ("bosch", "bvms", "vrm"), ("asf", "mov", "mp4"), "Path signal only: detect ZIP/native exports and ingest ASF/MOV/MP4 derived media directly."),
    Parser("milestone_xprotect", CCTV, MILESTONE, "medium", ("milestone", "xprotect"), ("blk", "avi", "mkv"), "Path signal only: detect XProtect packages; ingest AVI/MKV exports directly."),
    Parser("genetec_g64", CCTV, GENETEC, "medium", ("genetec",), ("g64", "g64x", "mp4", "asf"), "Path signal only: ingest MP4/ASF directly; preserve G64/G64x for player-assisted review."),
    Parser("avigilon_ave", CCTV, AVIGILON, "medium", ("avigilon", "/acc/"), ("ave", "avi"), "Path signal only: ingest AVI directly; preserve AVE exports for player-assisted review."),
    Parser("milesight", CCTV, "Milesight", "medium", ("milesight",), ("mp4", "avi", "mkv", "asf"), "Path signal only: ingest standard MP4/AVI/MKV/ASF exports directly; preserve EXE packages."),
    Parser("honeywell_research", RECOVERY, "Honeywell", "medium", ("honeywell",), (), "Research target only until validated sample images exist."),
    Parser("raw_h264_stream", RECOVERY, "DVR/NVR raw H.264 stream", "medium", (), ("264", "h264"), "Signature/extension target: validate elementary stream playback before reporting recovered video."),
    Parser("raw_h265_stream", RECOVERY, "DVR/NVR raw H.265 stream", "medium", (), ("265", "h265", "hevc"), "Signature/extension target: validate HEVC playback before reporting recovered video."),
)
#: Raw streams, and folders and names of dashcams.
LAYOUT_RULES = (
    Rule(RECOVERY, "DVR/NVR raw H.264 stream", "raw_h264_stream", "medium", ("264", "h264"), (), "Treat raw H.264 elementary streams as recovery candidates; wrap/transcode only as derived artifacts after playback validation.", "raw H.264-style extension: .{ext}"),
    Rule(RECOVERY, "DVR/NVR raw H.265 stream", "raw_h265_stream", "medium", ("265", "h265", "hevc"), (), "Treat raw H.265/HEVC streams as recovery candidates; validate decoder compatibility before export.", "raw H.265/HEVC-style extension: .{ext}"),
    Rule(DASHCAM, "Garmin-like DCIM dashcam", "garmin_dashcam", "medium", ("mp4", "mov", "glv"), ("/dcim/",), "Preserve DCIM layout and classify MP4/GLV companion files.", "DCIM folder with dashcam-compatible media"),
    Rule(DASHCAM, "BlackVue", "blackvue", "high", (), ("_nf.", "_nr.", "_ef.", "_er.", "_pf.", "_pr.", "_mf.", "_mr."), "Pair front/rear channel clips before review/export.", "BlackVue-style front/rear event suffix", True),
    Rule(DASHCAM, "Dashcam event-folder layout", "thinkware_inavi", "medium", ("mp4", "mov", "avi"), ("/continuous/", "/normal/", "/movie/", "/incident/", "/event/", "/parking/", "/motion/", "/manual/", "/impact/", "/상시/", "/이벤트/", "/주차/", "/충격/"), "Treat folder name as recording mode; verify model-specific metadata before making vendor claims.", "dashcam recording folder signal: {needle}"),
)
GENERIC = Rule("generic-video", "Generic media", "generic_media", "medium", (), (), "Use ffprobe/FFmpeg first; preserve original and export derived clips only when requested.", "")
RULES = (*EXTENSION_RULES, *(Rule(p.lane, p.vendor, p.id, p.confidence, (), p.path_needles, p.recommended_action, OF_PATH) for p in VENDOR_PARSERS if p.path_needles), *LAYOUT_RULES)


def source_profile(path: Column, extension: Column, format_name: Column | None = None, rules: Sequence[Rule] = RULES) -> Column:
    """struct(lane, vendor, parser, confidence, recommended_action, evidence): what the first rule that fits says, else the generic profile.

    Paths are compared with slashes, a leading one included, and A-Z lower-cased; a rule's
    needles in their order. Null paths, extensions and formats count as empty. The rules are
    one literal, so that each row is judged where it is read, without a join.
    """
    lower = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    low, ext, form = lower(slashed(F.coalesce(path, F.lit("")))), lower(F.coalesce(extension, F.lit(""))), F.lit("") if format_name is None else F.coalesce(format_name, F.lit(""))
    told = lambda r, evidence: [F.lit(v).alias(n) for n, v in zip(("lane", "vendor", "parser", "confidence", "recommended_action"), (r.lane, r.vendor, r.parser, r.confidence, r.action), strict=True)] + [evidence.alias("evidence")]
    rows = [
        F.struct(F.array(*map(F.lit, r.extensions)).cast("array<string>").alias("exts"), F.lit(n or "").alias("needle"), F.lit(r.in_name).alias("in_name"), *told(r, F.lit(r.evidence.replace("{needle}", n or ""))))
        for r in rules for n in (r.needles or (None,))
    ]
    seen = F.struct(F.when(low.startswith("/"), low).otherwise(F.concat(F.lit("/"), low)).alias("path"), F.substring_index(low, "/", -1).alias("name"), ext.alias("ext"))

    def first_fit(x: Column) -> Column:
        fits = lambda r: ((F.size(r["exts"]) == 0) | F.array_contains(r["exts"], x["ext"])) & F.when(r["in_name"], F.contains(x["name"], r["needle"])).otherwise(F.contains(x["path"], r["needle"]))
        return F.get(F.filter(F.array(*rows), fits), F.lit(0))

    # As elements of an array the lowered path and the rule are worked out once a row, not once a rule or field.
    hit = F.transform(F.array(seen), lambda x: F.struct(first_fit(x).alias("rule"), x["ext"].alias("ext")))
    generic = F.when(form != "", F.concat(F.lit("ffprobe format: "), form)).when(ext != "", F.concat(F.lit("standard media extension: ."), ext)).otherwise("video-like file signature")

    def profile(h: Column) -> Column:
        r = h["rule"]
        evidence = F.array(F.replace(r["evidence"], F.lit("{ext}"), h["ext"]))
        ruled = F.struct(*[r[c].alias(c) for c in ("lane", "vendor", "parser", "confidence", "recommended_action")], evidence.alias("evidence"))
        return F.when(r.isNull(), F.struct(*told(GENERIC, F.array(generic)))).otherwise(ruled)

    return F.get(F.transform(hit, profile), F.lit(0))


def parser_use(profiles: DataFrame, profile: str = "profile") -> DataFrame:
    """The list of parsers (position, id, lane, vendor, confidence, path_needles, extensions, recommended_action) with `records`: how many of `profiles` name the parser, its vendor and its lane."""
    rows = [(k, p.id, p.lane, p.vendor, p.confidence, list(p.path_needles), list(p.extensions), p.recommended_action) for k, p in enumerate((*EXTENSION_PARSERS, *VENDOR_PARSERS))]
    parsers = profiles.sparkSession.createDataFrame(rows, "position int, id string, lane string, vendor string, confidence string, path_needles array<string>, extensions array<string>, recommended_action string")
    n = profiles.groupBy(*[F.col(f"{profile}.{c}").alias(o) for c, o in (("parser", "id"), ("vendor", "vendor"), ("lane", "lane"), ("confidence", "confidence"))]).agg(F.count("*").alias("records"))
    return parsers.join(n, ["id", "vendor", "lane", "confidence"], "left").withColumn("records", F.coalesce("records", F.lit(0).cast("long"))).select(*parsers.columns, "records")


def confidence(probe_ok: Column, extension: Column, known: Sequence[str]) -> Column:
    return F.when(F.coalesce(probe_ok, F.lit(False)), "confirmed").when(F.lower(extension).isin(*known), "extension-candidate").otherwise("magic-candidate")


def validation_status(probe_ok: Column, video_codec: Column, format_name: Column) -> Column:
    """A probe that failed, found no video stream or only the catch-all demuxer confirms nothing."""
    failed = ~F.coalesce(probe_ok, F.lit(False)) | video_codec.isNull() | F.coalesce(format_name == "bin", F.lit(False))
    return F.when(failed, "validation-failed").otherwise("ffprobe-video-stream-confirmed")


#: What a browser plays, and extensions that need the vendor's tools.
BROWSER_CODECS = ("h264", "vp8", "vp9", "av1", "theora")
BROWSER_CONTAINERS = ("mp4", "mov", "webm", "matroska", "ogg")
PROPRIETARY = ("dav", "nov", "ave", "h264", "264", "h265", "sec", "ts")


def unplayable_reason(extension: Column, probe_ok: Column, format_name: Column, video_codec: Column) -> Column:
    """Why a browser cannot play the record; null if it can. An unknown container or codec is no reason."""
    ext, form, codec = F.lower(extension), F.lower(F.coalesce(format_name, F.lit(""))), F.lower(F.coalesce(video_codec, F.lit("")))
    return (
        F.when(ext.isin(*PROPRIETARY), F.concat(F.lit("proprietary extension ."), ext))
        .when(~F.coalesce(probe_ok, F.lit(True)), "ffprobe parse failed — proprietary or corrupt container")
        .when((form != "") & ~form.rlike("|".join(BROWSER_CONTAINERS)), F.concat(F.lit("container '"), form, F.lit("' not browser-playable")))
        .when((codec != "") & ~codec.isin(*BROWSER_CODECS), F.concat(F.lit("codec '"), codec, F.lit("' not browser-playable")))
    )


def fs_grade(total: Column, free: Column) -> Column:
    """intact, partial or overwritten by how many of a deleted file's units are still free; unknown without units."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, "unknown").when(free >= total, "intact").when(free > 0, "partial").otherwise("overwritten")


def header_ok(content: Column, extension: Column) -> Column:
    """Whether the first bytes fit the extension; null where no rule is known."""
    head = F.hex(F.substring(content, 1, 16))
    ext = F.lower(extension)
    return (
        F.when(ext.isin("mp4", "mov", "m4v", "3gp"), F.substring(head, 9, 8) == "66747970")
        .when(ext == "avi", (F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "41564920"))
        .when(ext == "dav", F.substring(head, 1, 8) == "44484156")
        .when(ext.isin("mkv", "webm"), F.substring(head, 1, 8) == "1A45DFA3")
        .when(ext == "ts", F.substring(head, 1, 2) == "47")
    )
