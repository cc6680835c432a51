"""suppress_nested: walked images and joined ones agree with a plain walk, over borders of Arrow batches; hits are worked out once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from caselake.operators import bytescan


def plain(rows, cap):
    out = []
    for image in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == image]
        spans, end = [], None
        for at, claim in sorted(((r[1], r[3]) for r in here if r[2] == "riff-avi" and r[3] is not None), key=lambda x: (x[0], -x[1])):
            if end is None or at >= end:
                end = at + 8 + min(claim, cap)
                spans.append((at, end))
        for r in here:
            met = r[1] + 4 * (r[2] == "mp4-ftyp")
            inside = [lo for lo, hi in spans if lo < met < hi] if image is not None else []
            if not inside or r[2] in bytescan.CONTAINERS:
                out.append((*r, inside[0] if inside else None))
    return sorted(out, key=str)


def test_nested_walk(spark):
    rng = random.Random(5)
    names = ["riff-avi", "jpeg", "mp4-ftyp", "h264-annexb", "dahua-dhav"]
    rows = list({(rng.choice(["a", "b", "c", None]), rng.randrange(3_000), rng.choice(names)) for _ in range(2_000)})
    rows = [(*r, rng.choice([None, 20, 60, 300, 90_000]) if r[2] == "riff-avi" else None) for r in rows]
    hits = spark.createDataFrame(rows, "image string, offset long, signature string, claim long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for cap in (100, bytescan.SPAN_CAP):
            for short in (None, 0):
                got = bytescan.suppress_nested(hits, cap=cap, short=short)
                assert got.columns == ["image", "offset", "signature", "claim", "nested_in"]
                assert sorted(map(tuple, got.collect()), key=str) == plain(rows, cap)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_hits_worked_out_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(value):
        rows.add(1)
        return value

    hits = spark.range(50).select(F.lit("a").alias("image"), F.udf(seen, "long")("id").alias("offset"), F.lit("riff-avi").alias("signature"), F.lit(20).cast("long").alias("claim"))
    assert bytescan.suppress_nested(hits).count() == 50
    # offset is asked for by two columns of one pass at most.
    assert rows.value <= 100
