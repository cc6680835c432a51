"""Running values and greedy chains against plain loops, over ranges of several widths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caselake.operators import scans
from caselake.operators.intervals import free_regions, hit_extents, merged, owner_asof
from caselake.operators.sequence import compress_runs, skipped_units, unit_runs


@pytest.fixture(params=[1, 4, 16])
def narrow(request, monkeypatch):
    """Ranges of 2, 16 and 65,536 positions."""
    monkeypatch.setattr(scans, "RANGE_BITS", request.param)
    for f in (scans.running, scans.following, scans.greedy_chain):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        values = dict(zip(names[-len(f.__defaults__) :], f.__defaults__, strict=True)) | {"bits": request.param}
        monkeypatch.setattr(f, "__defaults__", tuple(values.values()))
    return request.param


def sample(seed, keys=("a", "b", None), n=60, top=400):
    rng = random.Random(seed)
    return [(k, at - 50, rng.choice([None, rng.randint(-9, 90)])) for k in keys for at in sorted(rng.sample(range(top), n))]


def test_running_equals_a_loop(spark, narrow):
    rows = sample(1)
    df = spark.createDataFrame(rows, "k string, at long, v long")
    for how in ("max", "sum", "last"):
        for inclusive in (False, True):
            want = []
            for key in ("a", "b", None):
                so_far = None
                for k, at, v in (r for r in rows if r[0] == key):
                    now = so_far
                    if v is not None:
                        now = v if so_far is None or how == "last" else max(so_far, v) if how == "max" else so_far + v
                    want.append((str(k), at, now if inclusive else so_far))
                    so_far = now
            got = scans.running(df, ["k"], "at", "v", "out", how, inclusive=inclusive).collect()
            assert sorted((str(r["k"]), r["at"], r["out"]) for r in got) == sorted(want)


def test_following_equals_a_loop(spark, narrow):
    rows = sample(2)
    got = scans.following(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v", "out").collect()
    want = [(str(k), at, next((w for j, b, w in rows if j == k and b > at and w is not None), None)) for k, at, _ in rows]
    assert sorted((str(r["k"]), r["at"], r["out"]) for r in got) == sorted(want)


@pytest.mark.parametrize("longest", [3, 40])
def test_greedy_chain_equals_a_walk(spark, narrow, longest):
    rng = random.Random(longest)
    rows = [(k, at, at + rng.randint(1, longest)) for k, at, _ in sample(3, n=120)] + [("one", 5, 6)]
    want, end, key = [], None, ()
    for k, at, until in rows:
        if k != key or at >= end:
            want.append((str(k), at, until))
            end, key = until, k
    got = scans.greedy_chain(spark.createDataFrame(rows, "k string, at long, until long"), ["k"], "at", "until").collect()
    assert sorted((str(r["k"]), r["at"], r["until"]) for r in got) == sorted(want)


def test_a_giant_sequence_is_many_tasks(spark):
    df = spark.range(300_000).select(F.lit("one").alias("k"), (F.col("id") * 7).alias("at"), (F.col("id") % 1000).alias("v"))
    out = scans.running(df, ["k"], "at", "v", "out", "sum")
    total = out.agg(F.max("out")).first()[0]
    assert total == sum(i % 1000 for i in range(299_999))
    widest = df.groupBy("k", F.shiftright("at", scans.RANGE_BITS)).count().agg(F.max("count")).first()[0]
    assert widest < 10_000


def test_intervals_over_ranges(spark, narrow):
    rng = random.Random(4)
    rows = [("i", a, a + rng.randint(0, 30)) for a in (rng.randint(0, 2000) for _ in range(90))]
    df = spark.createDataFrame(rows, "image string, start_b long, end_b long")
    covered = {x for _, a, b in rows for x in range(a, b)}
    spans = sorted((r["start_b"], r["end_b"]) for r in merged(df, ["image"]).collect())
    assert {x for a, b in spans for x in range(a, b)} == covered and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    free = sorted((r["start_b"], r["end_b"]) for r in free_regions(df, spark.createDataFrame([("i", 2500)], "image string, size long"), least=1).collect())
    cuts = {a for _, a, b in rows if a == b} - covered
    assert {x for a, b in free for x in range(a, b)} == set(range(2500)) - covered and all(a[1] < b[0] or a[1] in cuts or a[1] == b[0] for a, b in zip(free, free[1:], strict=False))
    owners = [("i", a, b) for _, a, b in rows[:30]]
    points = [("i", x) for x in range(0, 2100, 7)] + [("i", 700)] * 5 + [("other", 3)]
    got = owner_asof(spark.createDataFrame(points, "image string, offset long"), spark.createDataFrame(owners, "image string, start_b long, owner long")).collect()
    want = [(i, x, max(((a, o) for _, a, o in owners if i == "i" and a <= x), default=(0, None))[1]) for i, x in points]
    assert sorted(map(str, ((r["image"], r["offset"], r["owner"]) for r in got))) == sorted(map(str, want))


def test_sequences_over_ranges(spark, narrow):
    rng = random.Random(5)
    units = sorted(rng.sample(range(300), 120))
    df = spark.createDataFrame([("i", u) for u in units + units[:9]], "image string, unit long")
    runs = sorted((r["first"], r["count"]) for r in unit_runs(df).collect())
    assert [u for a, n in runs for u in range(a, a + n)] == units and all(a + n < b for (a, n), (b, _) in zip(runs, runs[1:], strict=False))
    assert skipped_units(df).first()["skipped"] == units[-1] - units[0] + 1 - len(units)
    events = [("x", s, rng.choice("ab"), rng.choice("cd"), rng.random() < 0.8) for s in units]
    want = []
    for lane, s, source, kind, free in events:
        if want and free and want[-1][5] and want[-1][1:3] == (source, kind):
            want[-1] = (*want[-1][:4], s, True, want[-1][6] + 1)
        else:
            want.append((lane, source, kind, s, s, free, 1))
    got = compress_runs(spark.createDataFrame(events, "lane string, seq long, source string, kind string, unaudited boolean")).collect()
    assert sorted((r["lane"], r["source"], r["kind"], r["first_seq"], r["last_seq"], r["n"]) for r in got) == sorted((*w[:5], w[6]) for w in want)


def test_extents_over_ranges(spark, narrow):
    hits = spark.createDataFrame([("i", 0, "a", None), ("i", 2000, "b", 500_000), ("i", 2000, "c", None), ("i", 900_000, "d", None)], "image string, offset long, signature string, declared long")
    got = hit_extents(hits, spark.createDataFrame([("i", 1_000_000)], "image string, size long")).collect()
    assert sorted((r["offset"], r["signature"], r["length"], r["basis"]) for r in got) == [(0, "a", 2000, "next-boundary"), (2000, "b", 500_000, "declared"), (2000, "c", 898_000, "next-boundary"), (900_000, "d", 100_000, "next-boundary")]
