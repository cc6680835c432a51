"""Sequences short enough for one window or walk, and long ones cut into ranges: the same rows, and few shuffles for the short ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caselake.operators import bytescan, intervals, linkage, scans, sequence
from caselake.plans import QUERIES


@pytest.fixture(params=[0, 40, 500_000])
def short(request, monkeypatch):
    """All sequences long, some, none."""
    monkeypatch.setattr(scans, "SHORT", request.param)
    return request.param


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def spots(n=70, top=900, seed=1):
    rng = random.Random(seed)
    return [(k, a, a + rng.randint(0, 30)) for k, m in (("a", n), ("b", n // 3), ("c", 1)) for a in (rng.randint(0, top) for _ in range(m))]


def test_merged_and_uncovered(spark, short):
    rows = spots()
    df = spark.createDataFrame(rows, "image string, start_b long, end_b long")
    inside = {(k, x) for k, a, b in rows for x in range(a, b)}
    got = intervals.merged(df, ["image"]).collect()
    assert {(r["image"], x) for r in got for x in range(r["start_b"], r["end_b"])} == inside
    spans = [("a", 1, 0, 950), ("b", 2, 10, 400), ("z", 3, 5, 9)]
    free = intervals.uncovered(spark.createDataFrame(spans, "image string, span long, start_b long, end_b long"), df).collect()
    assert {(r["image"], x) for r in free for x in range(r["start_b"], r["end_b"])} == {(i, x) for i, _, a, b in spans for x in range(a, b)} - inside


def test_extents_of_repeated_places(spark, short):
    rows = [(k, a, s, None) for k, a, _ in spots() for s in ("x", "y")]
    df = spark.createDataFrame(rows, "image string, offset long, signature string, declared long")
    got = intervals.hit_extents(df, df.groupBy("image").agg((F.max("offset") + 50).alias("size")), least=0).collect()
    places = {k: sorted({a for i, a, _, _ in rows if i == k}) for k in "abc"}
    want = [(k, a, s, next((b for b in places[k] if b > a), places[k][-1] + 50) - a) for k, a, s, _ in rows]
    assert sorted((r["image"], r["offset"], r["signature"], r["length"]) for r in got) == sorted(want)


def test_owners_of_repeated_and_unknown_offsets(spark, short):
    owners = [(k, a, b) for k, a, b in spots(30)] + [(None, 0, 7), ("a", None, 5)]
    points = [(k, x) for k in ("a", "b", "z") for x in range(0, 900, 11)] + [("a", 450)] * 9000 + [(None, 4), ("a", None)]
    got = intervals.owner_asof(spark.createDataFrame(points, "image string, offset long"), spark.createDataFrame(owners, "image string, start_b long, owner long")).collect()
    find = lambda i, x: None if i is None or x is None else max(((a, o) for k, a, o in owners if k == i and a is not None and a <= x), default=(0, None))[1]
    assert sorted(map(str, ((r["image"], r["offset"], r["owner"]) for r in got))) == sorted(str((i, x, find(i, x))) for i, x in points)


def test_frame_runs_of_equal_and_empty_units(spark, short):
    rng = random.Random(3)
    rows = [("a", a, a + rng.choice([0, 1, 2, 3]), rng.random() < 0.6) for a in (rng.randint(0, 300) for _ in range(120))]
    rows += rows[:25] + [("b", 5, 9, True), ("b", 9, 12, True)]
    want, last = [], None
    for k, a, b, v in sorted(rows):
        if last and last[0] == k and a - last[1] in (0, 1):
            r = want[-1]
            want[-1] = (k, min(r[1], a), max(r[2], b), r[3] + 1, r[4] + v)
        else:
            want.append((k, a, b, 1, int(v)))
        last = (k, b)
    got = sequence.frame_runs(spark.createDataFrame(rows, "image string, start_b long, end_b long, is_video boolean"), least_video=2, slack=1).collect()
    assert sorted((r["image"], r["start_b"], r["end_b"], r["frames"], r["video"]) for r in got) == sorted(w for w in want if w[4] >= 2)


def test_a_long_image_of_frames_is_no_single_window(spark, monkeypatch):
    monkeypatch.setattr(scans, "SHORT", 0)
    units = spark.createDataFrame([("a", 0, 5, True)], "image string, start_b long, end_b long, is_video boolean")
    plan = sequence.frame_runs(units, least_video=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range2" in plan


def test_unit_chains_and_greedy_chains(spark, short):
    rng = random.Random(4)
    rows = [(i, "avi-frames", a, a + rng.choice([2, 3, 5]), rng.random() < 0.5, True) for i in "abc" for a in rng.sample(range(200), 60 if i == "a" else 20)]
    at = {(r[0], r[2]): r for r in rows}

    def chain(r):
        n, video, end = 0, 0, r[3]
        while r:
            n, video, end, r = n + 1, video + r[4], r[3], at.get((r[0], r[3]))
        return n, video, end

    got = bytescan.unit_chains(spark.createDataFrame(rows, "image string, kind string, start_b long, end_b long, is_video boolean, begins boolean")).collect()
    assert sorted((r["image"], r["start_b"], r["units"], r["video"], r["end_b"]) for r in got) == sorted((r[0], r[2], *chain(r)) for r in rows)
    want, end, key = [], None, None
    for r in sorted(rows):
        if r[0] != key or r[2] >= end:
            want.append((r[0], r[2]))
            key, end = r[0], r[3]
    steps = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "image string, lo long, hi long")
    assert sorted((r["image"], r["lo"]) for r in scans.greedy_chain(steps, ["image"], "lo", "hi").collect()) == want


def test_short_sequences_take_no_join(spark):
    df = spark.createDataFrame(spots(), "image string, start_b long, end_b long")
    shuffles, joins = exchanges(intervals.merged(df, ["image"]))
    assert shuffles <= 3 and joins == 0
    shuffles, joins = exchanges(intervals.owner_asof(df.select("image", F.col("start_b").alias("offset")), df.withColumn("owner", F.col("end_b"))))
    assert shuffles <= 2 and joins == 0
    assert exchanges(scans.greedy_chain(df.distinct(), ["image"], "start_b", "end_b"))[1] == 0


def test_a_hit_meets_frame_runs_once(spark):
    hits = spark.createDataFrame([("a", 5, "h264-annexb", None), ("a", 5, "riff-avi", None), ("a", 90, "h265-annexb", None), ("b", 5, "h264-annexb", None)], "image string, offset long, signature string, nested_in long")
    runs = spark.createDataFrame([("a", 0, 10), ("a", 4, 20)], "image string, start_b long, end_b long")
    out = intervals.lone_hits(hits, runs, 8)
    assert exchanges(out)[1] <= 1
    assert sorted((r["image"], r["offset"], r["signature"]) for r in out.collect()) == [("a", 5, "riff-avi"), ("a", 90, "h265-annexb"), ("b", 5, "h264-annexb")]


def test_channel_mates_deal_only_hot_keys(spark):
    rows = [(n, "k" if n < 12 else f"k{n // 2}", "FR"[n % 2]) for n in range(40)]
    df = spark.createDataFrame(rows, "id long, pair_key string, channel string")
    want = sorted((a, b) for a, k, c in rows for b, j, d in rows if k == j and c != d)
    for hot in (1, 5, 1000):
        assert sorted(map(tuple, linkage.channel_mates(df, hot=hot).collect())) == want
    assert exchanges(linkage.channel_mates(df)) == (1, 0)


def test_a_join_is_verified_with_one_deal_of_its_packets(spark, sf):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        none = jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    packets = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    before = shuffled()
    QUERIES["j24_kept_mode"](spark, sf).collect()
    assert shuffled() - before < 300 * packets
