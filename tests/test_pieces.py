"""Scans see chunks in small pieces: nothing is lost, doubled or moved at a border, and location sentences need no Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from caselake.operators import bytescan


def test_pieces_are_small(spark):
    data = bytes(range(256)) * 200
    rows = bytescan._pieces(spark.createDataFrame([("a", 7, bytearray(data)), ("b", 0, bytearray())], "image string, start_b long, bytes binary")).collect()
    whole = bytearray(len(data))
    for r in rows:
        assert len(r["bytes"]) <= bytescan.PIECE + bytescan.OVERLAP
        if r["image"] == "a":
            whole[r["start_b"] - 7 : r["start_b"] - 7 + len(r["bytes"])] = r["bytes"]
    assert bytes(whole) == data


def test_sentences_anywhere(spark):
    rng = random.Random(3)
    parts = [b"$GPRMC,", b"$GNGGA,", b"$GP\n", b"123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A", b"123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M", b"\r\n", b"\xff\x85", b"x" * 50, b"\x00"]
    data = b"".join(rng.choice(parts) for _ in range(4_000))
    df = spark.createDataFrame([("a", 5, bytearray(data))], "image string, start_b long, bytes binary")
    got = {r["offset"]: (r["lat"], r["alt_m"]) for r in bytescan.track_points(df).collect()}
    want = {}
    for m in re.finditer(rb"(?=(\$G[^\r\n](?:RMC|GGA),[^\r\n]{0,193}))", data):
        f = m.group(1).decode("ascii", "replace").split("*")[0].split(",")
        rmc = f[0][3:6] == "RMC"
        at = 3 if rmc else 2
        if (not rmc or f[2:3] == ["A"]) and f[at : at + 1] == ["4807.038"] and f[at + 2 : at + 3] == ["01131.000"]:
            want[5 + m.start()] = 545.4 if not rmc and f[9:10] == ["545.4"] else None
    assert len(want) > 100
    assert {k: v[1] for k, v in got.items()} == want
    assert "Python" not in bytescan.track_points(df)._jdf.queryExecution().executedPlan().toString() and "MapInPandas" not in bytescan.track_points(df)._jdf.queryExecution().executedPlan().toString()


def test_borders(spark):
    """Signatures, headers and packets around every border of pieces."""
    border = bytescan.PIECE
    for mark, name, back in ((b"IMKH", "hikvision-imkh", 0), (b"RIFF\x40\x00\x00\x00AVI ", "riff-avi", 0), (b"\x00\x00\x00\x00ftyp", "mp4-ftyp", 0), (b"\x00\x00\x00\x01\x67" + b"." * 500 + b"\x00\x00\x00\x01", "h264-annexb", 0)):
        rows = []
        for shift in range(-20, 6):
            data = bytearray(b"." * (3 * border))
            at = border + shift
            data[at : at + len(mark)] = mark
            rows.append((f"{name}{shift}", 0, data))
        got = bytescan.scan_signatures(spark.createDataFrame(rows, "image string, start_b long, bytes binary")).filter(F.col("signature") == name).collect()
        assert sorted((r["image"], r["offset"]) for r in got) == sorted((f"{name}{s}", border + s) for s in range(-20, 6))
    packets = b"".join(b"\x47" + bytes(187) for _ in range(30))
    rows = [(str(at), 0, bytearray(b"." * at + packets + b"." * 300)) for at in range(border - 1_200, border + 200, 97)]
    df = spark.createDataFrame(rows, "image string, start_b long, bytes binary")
    assert sorted((int(r["image"]), r["start_b"], r["packets"]) for r in bytescan.ts_runs(df).collect()) == sorted((int(r[0]), int(r[0]), 30) for r in rows)
    syncs = bytescan.scan_signatures(df).filter("signature = 'mpegts-sync'").collect()
    assert sorted((int(r["image"]), r["offset"]) for r in syncs) == sorted((int(r[0]), int(r[0])) for r in rows)
