"""Sources and sinks on real files."""

import hashlib
import json

import pytest

from caselake.operators import bytescan
from caselake.sources import chunks, readers, sinks

def test_records_and_coverage(spark, tmp_path):
    p = tmp_path / "videos.jsonl"
    p.write_text('{"id":"a","size_bytes":1,"modified_unix":0}\n\n{"id":"b","index_status":"stale","modified_unix":7}\n{"size_bytes":2}\n{"id":"c"\n')
    rows, cov = readers.read_records(spark, str(p))
    assert sorted((r["id"], r["modified_unix"], r["stale"]) for r in rows.collect()) == [("a", None, False), ("b", 7, True)]
    assert cov.first().asDict() == {"lines": 4, "records": 2, "bad_lines": 1, "without_id": 1, "stale": 1}


def test_hash_list_and_manifest(spark, tmp_path):
    p = tmp_path / "h.txt"
    p.write_text("# c\n; c\n" + "A" * 64 + "\n" + '"' + "a" * 64 + '","x"\nbad\n\n')
    rows, cov = readers.read_hash_list(spark, str(p))
    assert [r[0] for r in rows.collect()] == ["a" * 64] and cov.first().asDict() == {"read": 2, "ignored": 1}
    m = tmp_path / "m.tsv"
    m.write_text("source_path\tsha256\n#x\n\na/b.mp4\tAB\tignored\nc.mp4\n")
    assert sorted(tuple(r) for r in readers.read_manifest(spark, str(m)).collect()) == [("a/b.mp4", "ab"), ("c.mp4", None)]


def test_fs_listing(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("r/r * 12-128-1:\tdir/a.MP4\tt\tt\tt\tt\t99\t0\t0\nd/d 3:\tdir\tt\tt\tt\tt\t0\t0\t0\nv/v 5:\tx.mp4\tt\tt\tt\tt\t1\t0\t0\njunk\n")
    rows, cov = readers.read_fs_listing(spark, str(p))
    assert sorted(tuple(r) for r in rows.select("inode", "deleted", "video_candidate", "size_bytes").collect()) == [("12-128-1", True, True, 99), ("3", False, False, 0), ("5", False, False, 1)]
    assert cov.first()["bad_lines"] == 1


def test_lanes_keep_blank_lines_and_torn_tails(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_text("x\n\ny\n")
    (tmp_path / "b.jsonl").write_text("z")
    lines, torn = readers.read_lanes(spark, str(tmp_path))
    assert sorted(tuple(r) for r in lines.collect()) == [("b.jsonl", 1, "z"), ("logs/a.jsonl", 1, "x"), ("logs/a.jsonl", 2, ""), ("logs/a.jsonl", 3, "y")]
    assert [r[0] for r in torn.collect()] == ["b.jsonl"]


def test_annotations(spark, tmp_path):
    doc = {"schema_version": 1, "case_id": "c", "tags": [{"id": "a", "tags": ["t"]}], "marks": [{"id": "a", "status": "noted", "range": {"in": 1, "out": 2}}, {"id": "b", "status": "odd"}, {"id": "c", "status": "noted", "range": {"in": 1, "end": 2}}, {"id": "d", "status": "noted", "range": {"in": 3, "out": 2}}]}
    (tmp_path / "1.json").write_text(json.dumps(doc))
    (tmp_path / "2.json").write_text(json.dumps({"schema_version": 1, "case_id": "other", "marks": [{"id": "z", "status": "noted"}]}))
    marks, tags, errors = readers.read_annotations(spark, str(tmp_path), "c")
    assert [r["id"] for r in marks.collect()] == ["a"] and tags.count() == 1
    assert sorted((r["id"], r["error"]) for r in errors.collect() if r["id"]) == [("b", "unknown-status"), ("c", "unknown-range-key"), ("d", "bad-range")]
    assert [r["error"] for r in errors.collect() if not r["id"]] == ["other-case"]


def test_sidecars(spark, tmp_path):
    (tmp_path / "vid_000001.json").write_text('{"status":"done","score":0.5}')
    got = readers.read_sidecars(spark, str(tmp_path), "status string, score double").first()
    assert (got["id"], got["score"]) == ("vid_000001", 0.5)


def test_catalog_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.MP4").write_bytes(b"1")
    (tmp_path / "a/b/y.bin").write_bytes(b"RIFF\0\0\0\0AVI LIST")
    (tmp_path / "a/z.txt").write_bytes(b"1")
    got, coverage = readers.catalog_files(spark, str(tmp_path), with_hash=True)
    got = got.orderBy("relative_path").collect()
    assert [(r["relative_path"], r["size_bytes"], r["hash_status"]) for r in got] == [("a/b/y.bin", 16, "hashed"), ("a/x.MP4", 1, "hashed")]
    assert got[1]["sha256"].startswith("6b86b273") and coverage.first().asDict() == {"files": 3, "listed": 1, "by_first_bytes": 1, "too_deep": 0, "in_excluded": 0, "other": 1, "unreadable": 0}
    shallow, coverage = readers.catalog_files(spark, str(tmp_path), max_depth=2, sniff=False, excluded=("b",))
    assert shallow.count() == 1 and coverage.first()["too_deep"] == 1
    assert readers.catalog_files(spark, str(tmp_path), excluded=("a",))[1].first()["in_excluded"] == 3


def test_a_file_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 10
    with open(tmp_path / "big.bin", "wb") as f:
        f.write(b"\0\0\0\x18ftypmp42")
        f.truncate(size)
    got = readers.catalog_files(spark, str(tmp_path), with_hash=True)[0].first()
    digest = hashlib.sha256(b"\0\0\0\x18ftypmp42")
    left, block = size - 12, bytes(1 << 24)
    while left:
        digest.update(block[: min(left, len(block))])
        left -= min(left, len(block))
    assert (got["size_bytes"], got["sha256"]) == (size, digest.hexdigest())


def test_sentences_end_at_binary_bytes_and_across_chunks(spark):
    one = b"$GPRMC,123519,A,807.038,,01131.000,W,1,1,230399,,*00"
    data = b"\0" * 90 + one + b"\0\xff" * 100 + one
    schema = "image string, start_b long, bytes binary"
    for cut in (95, 120, 500):
        chunks = [("i", 0, data[:cut]), ("i", max(0, cut - 250), data[max(0, cut - 250) :])]
        got = bytescan.track_points(spark.createDataFrame(chunks, schema)).orderBy("offset").collect()
        assert [r["offset"] for r in got] == [90, 90 + len(one) + 200]
        assert all(abs(r["lat"] - (8 + 7.038 / 60)) < 1e-9 and r["lon"] < 0 and r["day"] == "1999-03-23" for r in got)


def image():
    nmea = b"$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A\r\n$GPRMC,123520,V,4807.038,N,01131.000,E,0,0,230394,,*00\r\n$GPGGA,123519,4807.038,S,01131.000,W,1,08,0.9,545.4,M,,*47\r\n$GPRMC,123519,A,4860.000,N,01131.000,E,1,1,230394,,*00\r\n"
    frame = b"DHAV\xfd\x00\x01\x00\x07\x00\x00\x00\x00\x01\x00\x00" + (5).to_bytes(4, "little") + (9).to_bytes(2, "little") + b"\0\0"
    return b"\0" * 1000 + b"\0\0\0\x18ftypmp42" + b"\0" * 5 + b"RIFF" + (2000).to_bytes(4, "little") + b"AVI " + b"\xff\xd8\xff" * 2 + b"\0" * 100 + b"ftyp" + b"\0" * 3000 + nmea + frame + b"\0" * 300 + (b"\x47" + b"\1" * 187) * 6 + b"\0" * 50


def test_scans_do_not_depend_on_chunks(spark, tmp_path):
    p = tmp_path / "disk.img"
    p.write_bytes(image())
    found = []
    for chunk in (257, 1024, 1 << 20):
        c = chunks.read_chunks(spark, str(p), chunk=chunk, overlap=800)
        hits = bytescan.scan_signatures(c)
        found.append((sorted((r["offset"], r["signature"], r["declared"]) for r in hits.collect()), sorted(tuple(r)[1:] for r in bytescan.frame_headers(c).collect()), sorted(tuple(r)[1:] for r in bytescan.track_points(c).collect())))
        assert found[-1] == found[0]
    signatures = found[0][0]
    assert (1000, "mp4-ftyp", None) in signatures and (1017, "riff-avi", 2008) in signatures and [s for s in signatures if s[1] == "mpegts-sync"]
    assert len(found[0][1]) == 1 and found[0][1][0][4] == 9
    assert [(round(p[1], 4), p[4], p[5] and round(p[5], 2)) for p in found[0][2]] == [(48.1173, 45319, 41.48), (-48.1173, 45319, None)]


HITS = "image string, offset long, signature string, claim long"


def test_signature_rules(spark):
    nal = lambda *kinds: b"".join(b"\0\0\0\1" + bytes([k]) for k in kinds)
    data = {
        "four": b"xx" + nal(0x67, 0x42, 0x40, 0x27), "three": b"x\0\0\1\x67" + b"x\0\0\1\x42" + b"x\0\0\0\1\x67", "far": nal(0x67) + b"x" * 513 + nal(0x27), "near": nal(0x67) + b"x" * 508 + nal(0x27),
        "packs": b"".join(b"\0\0\1\xba" + bytes([k]) for k in range(256)), "avi": b"RIFF\x40\0\0\0AVI RIFF\x40\0\0\0AVIX" + b"RIFF\x09\0\0\0AVI ", "both": b"IMKHftyp", "wav": b"RIFF\x40\0\0\0WAVE",
    }
    rows = [(k, 0, bytearray(v)) for k, v in data.items()]
    found = bytescan.scan_signatures(spark.createDataFrame(rows, "image string, start_b long, bytes binary"))
    got = sorted((r["image"], r["offset"], r["signature"], r["declared"], r["claim"]) for r in found.collect())
    assert got == [
        ("avi", 0, "riff-avi", 72, 64), ("avi", 12, "riff-avi", None, None), ("avi", 24, "riff-avi", None, 9), ("both", 0, "hikvision-imkh", None, None),
        ("four", 2, "h264-annexb", None, None), ("four", 7, "h265-annexb", None, None), ("four", 12, "h265-annexb", None, None), ("near", 0, "h264-annexb", None, None),
        ("packs", 5 * 0x21, "mpeg-ps", None, None), ("packs", 5 * 0x44, "mpeg-ps", None, None),
    ]


def test_nested_and_thinned(spark):
    h = spark.createDataFrame([("i", 100, "riff-avi", 992), ("i", 150, "jpeg", None), ("i", 180, "dahua-dhav", None), ("i", 190, "hikvision-imkh", None), ("i", 200, "mp4-ftyp", None), ("i", 97, "mp4-ftyp", None), ("i", 300, "riff-avi", 5000), ("i", 1200, "jpeg", None), ("i", 1100, "jpeg", None), ("i", 1099, "mpeg-ps", None)], HITS)
    assert sorted((r["offset"], r["nested_in"]) for r in bytescan.suppress_nested(h).collect()) == [(97, 100), (100, None), (180, 100), (190, 100), (200, 100), (300, 100), (1100, None), (1200, None)]
    capped = bytescan.suppress_nested(h, cap=150).collect()
    assert sorted((r["offset"], r["nested_in"]) for r in capped if r["offset"] > 200) == [(300, None), (1099, None), (1100, None), (1200, None)]
    a = spark.createDataFrame([("i", x, ("h264-annexb", "h265-annexb")[x % 2], None) for x in (0, 5, 9, 11, 19, 25)] + [("i", 3, "jpeg", None), ("i", 4, "mpegts-sync", None), ("i", 6, "mpegts-sync", None), ("i", 7, "mpeg-ps", None), ("i", 8, "mpeg-ps", None)], HITS)
    assert sorted(r["offset"] for r in bytescan.thin_anchors(a, step=10).collect()) == [0, 3, 4, 6, 7, 8, 11, 25]


def test_ts_runs(spark, tmp_path):
    p = tmp_path / "x.img"
    p.write_bytes(b"\0" * 77 + (b"\x47" + b"\1" * 187) * 9 + b"\0" * 500)
    for chunk, overlap in ((300, 400), (100, 0), (1 << 20, 752)):
        got = bytescan.ts_runs(chunks.read_chunks(spark, str(p), chunk=chunk, overlap=overlap)).collect()
        assert [(r["start_b"], r["end_b"], r["packets"]) for r in got] == [(77, 77 + 9 * 188, 9)]


def test_sinks(spark, tmp_path):
    cat = spark.createDataFrame([("vid_000001", "a\u0001b.mp4", "=x", 5, 7, "AB", False), ("vid_000002", None, "y", None, None, None, True)], "id string, source_path string, relative_path string, size_bytes long, modified_unix long, sha256 string, stale boolean")
    sinks.write_index(cat, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/videos.parquet")).count() == 2
    assert readers.read_records(spark, str(tmp_path / "db/videos.jsonl"))[0].count() == 2
    counts = sinks.write_dfxml(cat, str(tmp_path / "x"))
    assert counts.first().asDict() == {"written": 1, "skipped": 1, "stale": 1}
    assert spark.read.format("xml").option("rowTag", "fileobject").load(str(tmp_path / "x")).first()["filename"] == "a�b.mp4"
    sinks.write_safe_csv(cat, str(tmp_path / "c"))
    assert "'=x" in {r["relative_path"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_lanes_in_splits_equal_whole_texts(spark, tmp_path, split):
    """Blank lines, torn tails, carriage returns, line separators of Unicode, a byte order mark, lines longer than a split."""
    lanes = {
        "a.jsonl": "one\n\n\nfour" + "x" * 300 + "\n" + "".join(f"line {k}\n" for k in range(200)), "b/torn.jsonl": "1\n2\n3", "b/c/blank.jsonl": "\n", "cr.jsonl": "x\r\ny\r\n\r", "sep.jsonl": "p q\x85r\n\n",
        "mark.jsonl": "﻿first\nsecond\n", "marktorn.jsonl": "﻿1\n2", "empty.jsonl": "", "one.jsonl": "y" * 3000, "skip.txt": "no\n",
    }
    for name, text in lanes.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines, torn = readers.read_lanes(spark, str(tmp_path))
        got, open_ = sorted(map(tuple, lines.collect())), sorted(r["lane"] for r in torn.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(name, n, raw) for name, text in lanes.items() if text and name.endswith(".jsonl") for n, raw in enumerate(text.removesuffix("\n").split("\n"), 1)]
    assert got == sorted(want)
    assert open_ == sorted(n for n, t in lanes.items() if t and not t.endswith("\n") and n.endswith(".jsonl"))
    whole, torn = readers.lines_of(spark.createDataFrame([(n, t) for n, t in lanes.items() if n.endswith(".jsonl")], "lane string, value string"))
    assert sorted(map(tuple, whole.collect())) == got and sorted(r["lane"] for r in torn.collect()) == open_
