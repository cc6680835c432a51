"""Columns read from names, paths, tags and text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from caselake.functions import paths, profile, times
from caselake.functions.redact import host_token, redact
from caselake.operators.lanes import recency_keys
from caselake.sources.sinks import safe_cell

#: Names and what they say: naive seconds, text, has_time.
NAMES = [
    ("20260916-13h41m15s.mp4", (1789566075, "2026-09-16 13:41:15", True)),
    ("2026_09_16 13h41m15s_F.mp4", (1789566075, "2026-09-16 13:41:15", True)),
    ("REC_2026-09-16_13H41M15S.avi", (1789566075, "2026-09-16 13:41:15", True)),
    ("20260910_120000_F.mp4", (1789041600, "2026-09-10 12:00:00", True)),
    ("2026-09-10T12:00:00.mp4", (1789041600, "2026-09-10 12:00:00", True)),
    ("2026.09.10-12.00.00.avi", (1789041600, "2026-09-10 12:00:00", True)),
    ("20260910 120000.mp4", (1789041600, "2026-09-10 12:00:00", True)),
    ("C:/증거/전방 영상/20260910_120000_F.mp4", (1789041600, "2026-09-10 12:00:00", True)),
    ("20260910.mp4", (1788998400, "2026-09-10", False)),
    ("2026-09-10_backup/clip.mp4", (1788998400, "2026-09-10", False)),
    ("202609101", None),
    ("20261301_120000", None),
    ("20260230_120000", (1772452800, "2026-02-30 12:00:00", True)),
    ("20260910_250000", (1788998400, "2026-09-10", False)),
    ("2026-09-10 12-00-00", (1789041600, "2026-09-10 12:00:00", True)),
    ("190012", None),
    ("video_2026_0910_1200_00.mp4", (1789041600, "2026-09-10 12:00:00", True)),
    ("x20260910T120000Zfront", (1789041600, "2026-09-10 12:00:00", True)),
    ("20260910_12h00m00s", (1789041600, "2026-09-10 12:00:00", True)),
    ("", None),
    ("2026-09-10_12:00", (1788998400, "2026-09-10", False)),
    ("20990101_000000", (4070908800, "2099-01-01 00:00:00", True)),
    ("2026091012000", None),
    ("dashcam 2026-09-16-13h41m15s", (1789566075, "2026-09-16 13:41:15", True)),
    ("2026_09_16t13h41m15s", (1789566075, "2026-09-16 13:41:15", True)),
    ("2026-09-10t12:00:00", (1788998400, "2026-09-10", False)),
    ("NORMAL/20261231_235959_R.MP4", (1798761599, "2026-12-31 23:59:59", True)),
    ("20260910__--120000", (1789041600, "2026-09-10 12:00:00", True)),
    ("2026-0910_120000", (1789041600, "2026-09-10 12:00:00", True)),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_recording_time(spark):
    got = column(spark, [n for n, _ in NAMES], times.recording_time)
    assert [None if g is None else (g["secs_naive"], g["text"], g["has_time"]) for g in got] == [w for _, w in NAMES]


def test_first_name_with_any_time_wins(spark):
    df = spark.createDataFrame([("none", "20260910.mp4", "20260911_120000")], "a string, b string, c string")
    assert df.select(times.recording_time(*map(F.col, "abc")).alias("t")).first()["t"]["date"] == "2026-09-10"


def test_creation_time(spark):
    cases = [
        ("2024-01-02T03:04:05Z", (1704164645, False)), ("2024-01-02 03:04:05", (1704164645, True)), ("2024-01-02T03:04:05.123+09:00", (1704132245, False)),
        ("2024-01-02", (1704153600, True)), ("2024-02-30T00:00:00Z", None), ("2024-01-02T03:04:60Z", None), ("1969-12-31T23:59:59Z", None), ("x", None), (None, None),
    ]
    got = column(spark, [c for c, _ in cases], times.creation_time)
    assert [None if g is None else (g["unix"], g["tz_assumed"]) for g in got] == [w for _, w in cases]


def test_packed_date(spark):
    packed = (26 << 26) | (9 << 22) | (10 << 17) | (12 << 12) | (0 << 6) | 7
    assert column(spark, [packed, (26 << 26) | (2 << 22) | (30 << 17)], times.packed_date, "long") == [1789041607, None]


@pytest.mark.parametrize("name,code", [("a_F.mp4", "F"), ("clip-r01", "R"), ("front.mp4", "F"), ("inside.avi", "I"), ("forest.mp4", None), ("x_B_1.mp4", "B")])
def test_channel(spark, name, code):
    assert column(spark, [name], paths.channel_code) == [code]


def test_paths(spark):
    p = "\\\\?\\C:\\Evid\\cam1\\20240101_1200_F.mp4"
    assert column(spark, [p], paths.path_key) == ["C:\\Evid\\cam1\\20240101_1200_F.mp4"]
    assert column(spark, ["clip.mp4", "/a/b/c.mp4"], paths.parent_dir) == ["Root", "b"]
    assert column(spark, ["D/20240101_1200_F.mp4", "d\\20240101_1200_R.mp4", "front.mp4"], paths.pair_key) == ["d|20240101_1200", "d|20240101_1200", ""]
    assert column(spark, ["/x/Parking/e.mp4", "충격_1.mp4", "z"], paths.rec_type) == ["parking", "event", ""]
    assert column(spark, ["REC_001.mp4", "001"], paths.prefix) == ["REC", "other"]
    assert sorted(column(spark, ["c10", "c9", "c010a"], paths.natural_key))[0].endswith("9")


def test_profile(spark):
    rows = [(1, "x/Hikvision/a.dav", "dav"), (2, "x/hikvision/a.mp4", "mp4"), (3, "dss/a.asf", "asf"), (4, "a.h264", "h264"), (5, "a/DCIM/b.mov", "mov"), (6, "b.mov", "mov")]
    df = spark.createDataFrame(rows, "id int, relative_path string, extension string")
    p = profile.source_profile(F.col("relative_path"), F.col("extension"))
    got = {r["id"]: r["p"]["parser"] for r in df.select("id", p.alias("p")).collect()}
    assert got == {1: "dahua_dav", 2: "hikvision", 3: "dahua_dav", 4: "raw_h264_stream", 5: "garmin_dashcam", 6: "generic_media"}
    own = profile.Rule("lane", "Own", "own_parser", "high", ("mov",), ("dcim",), "act", "{needle} with {ext}")
    rows = df.select(profile.source_profile(F.col("relative_path"), F.col("extension"), rules=(own, *profile.RULES)).alias("p")).collect()
    assert rows[4]["p"].asDict() == {"lane": "lane", "vendor": "Own", "parser": "own_parser", "confidence": "high", "recommended_action": "act", "evidence": ["dcim with mov"]}
    none = spark.range(1).select(profile.source_profile(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p")).first()["p"]
    assert none["parser"] == "generic_media" and none["evidence"] == ["video-like file signature"]


def test_header_ok(spark):
    df = spark.createDataFrame([(bytearray(b"\0\0\0\x18ftypmp42"), "mp4"), (bytearray(b"RIFF\0\0\0\0AVI LIST"), "avi"), (bytearray(b"junk"), "dav"), (bytearray(b"x"), "txt")], "c binary, e string")
    assert [r[0] for r in df.select(profile.header_ok(F.col("c"), F.col("e"))).collect()] == [True, True, False, None]


def test_redact(spark):
    text = "open C:\\a\\b.mp4 and /cases/c1/db/x.json; https://h/x/y /etc/passwd twice /etc/passwd"
    out = column(spark, [text, None, ""], lambda c: redact(c, "/cases/c1"))
    assert out[1] is None and out[2] == "" and "<case>/db/x.json;" in out[0] and "https://h/x/y" in out[0]
    assert "passwd" not in out[0] and "C:" not in out[0] and out[0].count("<redacted:") == 3
    assert out[0].split(" ")[-1] == out[0].split(" ")[-3]


#: Texts with a path or address in them, that must not be seen, and texts that must stay.
HIDDEN = (
    "/home/kim/My Videos/secret.mp4", "/kim.mp4", r"원본경로:D:\Evidence\kim\a.mp4", r"path:C:\Users\kim\a.mp4", "**/home/kim/clip.mp4", "경로:/home/kim/clip.mp4", "참고/home/kim/clip.mp4",
    "see //nas01/share/kim/a.mp4 now", "참고//nas01/share/kim/a.mp4", "smb://nas01/share/kim/a.mp4", "경로:smb://nas01/share/kim/a.mp4", "NFS://nas01/export/kim", r"line one\nC:\Users\kim\a.mp4",
    r"line one\n/home/kim/a.mp4", r"tab\t/home/kim/a.mp4", r"C:\Users\Kim Park\kim clip.mp4", "see ~/Videos/kim/a.mp4 now", r"경로:~\Videos\kim\a.mp4", "file:///home/kim/a.mp4", "C__Users_kim_cam1_proxy_1.mp4",
    "built _evidence_kim-sd_cam1_mp4_proxy_1.mp4.", r"\\nas01\share\kim.avi", r"\\?\C:\kim\a.mp4", "(/mnt/kim/x.mp4)",
)
KEPT = (
    "https://example.com/a/b", "판독/검증", "IN/OUT 구간 1/2, and/or 16/9", "ratio: 4:3 a:b", "</td><td>x</td>", "and/or", "<case>/artifacts/clips/out.mp4", "index.html#/records/vid_1", "x*/2", "a*/b/c", "_run_id", "_tmp_value",
    "__init__", "#!/route/x", "camera/a.mp4", "vid_000001",
)


def test_no_part_of_a_path_stays(spark):
    hidden = column(spark, HIDDEN, lambda c: redact(c, "/cases/c1", ("/evidence/kim-sd",)))
    for text, out in zip(HIDDEN, hidden, strict=True):
        assert "kim" not in out.lower() and "nas01" not in out and "<redacted" in out, (text, out)
    assert column(spark, KEPT, lambda c: redact(c, "/cases/c1", ("/evidence/kim-sd",))) == list(KEPT)
    assert column(spark, hidden, lambda c: redact(c, "/cases/c1", ("/evidence/kim-sd",))) == hidden
    case = "exported to /cases/c1/clips/out.mp4. Gone: /cases/c1/C__Users_kim_proxy.mp4, /cases/c1/../kim"
    out = column(spark, [case], lambda c: redact(c, "/cases/c1"))[0]
    assert out.startswith("exported to <case>/clips/out.mp4. Gone: <case>/<redacted:") and "kim" not in out
    assert column(spark, ["SECRET", None], host_token) == [f"<redacted-host:{hashlib.sha256(b'SECRET').hexdigest()[:16]}>", None]


def test_safe_cell(spark):
    cells = ["=1+1", "+5", "-3.5", "-x", "@a", "ok", "\tz", None]
    assert column(spark, cells, safe_cell) == ["'=1+1", "+5", "-3.5", "'-x", "'@a", "ok", "'\tz", None]


def test_recency_keys(spark):
    rows = [
        ("x.jsonl", '{"id":"a","output_path":"o"}', ["id=a", "output_path=o"]),
        ("artifacts/clips/export-log.jsonl", '{"selector":"s","output_path":"o"}', ["output_path=o"]),
        ("evidence/logs/signoff-log.jsonl", '{"id":"a"}', []),
        ("r.jsonl", '{"event":"recover-inode","inode":7}', ["inode=0:7"]),
        ("evidence/logs/hash-verify.jsonl", '{"event":"hash-verify-run","run_id":"r1"}', ["run_id=r1"]),
        ("q.jsonl", '{"event":"transcode-queue"}', ["event=transcode-queue"]),
    ]
    df = spark.createDataFrame(rows, "lane string, body string, want array<string>")
    assert [r[0] for r in df.select(recency_keys(F.col("lane"), F.col("body"))).collect()] == [w for *_, w in rows]
