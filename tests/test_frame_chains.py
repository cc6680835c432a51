"""Frame chains against a plain walk through the bytes, at several chunk sizes."""

from __future__ import annotations

import random

import pytest

from caselake.operators import bytescan
from caselake.sources import chunks

VIDEO = 4


def unit_at(data, at, starting):
    """(length, is video) of the AVI chunk at a place, or None."""
    name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
    if len(data) < at + 8 or not 0 < size <= bytescan.MOST_AVI_CHUNK:
        return None
    stream = name[:2].isdigit()
    video, audio = stream and name[2:] in (b"dc", b"db"), stream and name[2:] == b"wb"
    filler = not starting and (name[:2] == b"ix" and name[2:3].isdigit() or name == b"JUNK")
    return (8 + size + size % 2, video) if video or audio or filler else None


def walk(data):
    at, runs = 0, []
    while at < len(data):
        first = unit_at(data, at, True)
        if first is None or unit_at(data, at + first[0], False) is None:
            at += 1
            continue
        end, units, video = at, 0, 0
        while (unit := unit_at(data, end, False)) is not None:
            end, units, video = end + unit[0], units + 1, video + unit[1]
        if video >= VIDEO:
            runs.append((at, end, units, video))
            at = end
        else:
            at += 1
    return runs


def disk(seed):
    rng = random.Random(seed)
    out = b""
    for _ in range(40):
        kind = rng.choice([b"00dc", b"01db", b"01wb", b"JUNK", b"ix00", b"xxxx", b"00dx"])
        size = rng.choice([0, 1, 2, 7, 30, 9 << 20]) if rng.random() < 0.3 else rng.randint(1, 20)
        for _ in range(rng.randint(1, 6)):
            out += kind + size.to_bytes(4, "little") + bytes(rng.choice(b".0dc") for _ in range(size % 64 + size % 2))
        out += b"." * rng.choice([0, 0, 0, 3])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_a_walk(spark, tmp_path, seed):
    data = disk(seed)
    p = tmp_path / "disk.img"
    p.write_bytes(data)
    want = walk(data)
    for chunk in (97, 1 << 20):
        units = bytescan.frame_units(chunks.read_chunks(spark, str(p), chunk=chunk, overlap=40))
        got = bytescan.frame_chains(units.filter("kind = 'avi-frames'"), VIDEO).collect()
        assert sorted((r["start_b"], r["end_b"], r["units"], r["video"]) for r in got) == want
    assert want


def test_dhav_frames(spark):
    frame = lambda kind, n: b"DHAV" + bytes([kind, 0, 1, 0]) + b"\0" * 4 + (32 + n).to_bytes(4, "little") + b"\0" * (16 + n)
    data = b"x" * 11 + b"".join(frame(0xFD, k) + frame(0xF0, 3) for k in range(200)) + b"y" * 9 + frame(0xFD, 0) * 5
    units = bytescan.frame_units(spark.createDataFrame([("i", 0, bytearray(data))], "image string, start_b long, bytes binary"))
    got = bytescan.frame_chains(units).collect()
    assert [(r["kind"], r["start_b"], r["end_b"], r["units"], r["video"]) for r in got] == [("dhav-frames", 11, 11 + sum(32 + k + 35 for k in range(200)), 400, 200)]
