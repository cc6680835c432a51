"""Hard negatives against brute force over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from caselake.llm import hard_negatives as H
from caselake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, block long"


def brute(rows):
    """All (anchor, positive, rank, negative, scores), by plain loops over (vec_id, vector, label)."""
    fit = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, a, label) in enumerate(fit):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, m, n) for n, (j, v, m) in enumerate(fit) if len(v) == len(a))
        for s, j, _, _ in [r for r in scored if r[2] == label and r[3] != k][:5]:
            got = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(got)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_hilbert_keys_walk_the_grid_step_by_step():
    for dims, bits in ((1, 4), (2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = H.hilbert_keys(grid, bits)
        assert len(set(keys)) == len(grid)
        walk = grid[np.argsort(np.array([int.from_bytes(k) for k in keys]))]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(2)
    a, v = rng.integers(-90, 90, (20, 6)), rng.integers(-90, 90, (40, 6))
    least, most = H.bounds(a, v.min(axis=0, keepdims=True), v.max(axis=0, keepdims=True))
    got = H.products(a, v)
    assert (least <= got).all() and (got <= most).all()
    big = np.array([[1 << 30, 3]])
    assert H.products(big, big).tolist() == [[(1 << 60) + 9]]


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(H, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(H, "CHUNK_BLOCKS", 3)
    monkeypatch.setattr(H, "ZONES", 8)
    rng = random.Random(block_rows)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(420):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c], rng.randint(0, 3)))
    rows += [(450, [0.0] * 6, 1), (500, [1.0] * 6, 9), (550, None, 1), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (650, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 1), (750, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(50, rows[50][1], rows[50][2])] + [(1000 + k, rows[100][1], rows[100][2]) for k in range(40)] + [(1050, [0.5, 0.5], 1), (1051, [0.5, 0.4], 1), (1052, [0.3, 0.4], 2), (1100, [], 1), (1101, [], 1), (1102, [], 2)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert mined(H.mine(df)) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.mine(spark.createDataFrame([(1, [1.0], 1, 0), (2, [1.0], 2, 0)], SCHEMA)).count() == 0


def test_query_over_its_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert mined(QUERIES["op13_hard_negatives"](spark, d)) == brute(rows)


def test_tables_between_hold_no_row_per_anchor_and_block(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 8), ("CHUNK_BLOCKS", 200), ("ZONES", 8)):
        monkeypatch.setattr(H, name, n)
    written, write = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: written.append(write(df)) or written[-1])
    rng = random.Random(5)
    # In 24 dimensions bounds prune nothing; all rows are anchors; many agree in id and vector, so that no range parts them.
    rows = [(50 * i, [rng.gauss(0, 0.2) for _ in range(24)], rng.randint(0, 3)) for i in range(600)]
    rows += [(50, rows[1][1], 1 + k % 2) for k in range(300)]
    assert mined(H.mine(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))) == brute(rows)
    assert max(t.count() for t in written) <= 16 * len(rows)
    anchors = next(t for t in written if "home" in t.columns)
    most = lambda c: max(r["count"] for r in anchors.groupBy(c).count().collect())
    assert most("home") <= 8 and "chunk" in anchors.columns and most("chunk") <= 200 * 8 // 50


@pytest.mark.parametrize("scale", [40, 40_000, 100_000_000])
@pytest.mark.parametrize("own", [True, False])
def test_a_group_is_searched_exactly_in_any_number_type(scale, own):
    rng = np.random.default_rng(scale)
    v = np.concatenate([rng.integers(-scale, scale, (90, 5)), np.full((30, 5), scale)])
    block, label, ids, pos = np.arange(120) // 40, rng.integers(0, 3, 120), rng.integers(0, 60, 120), rng.permutation(120)
    rows = pd.DataFrame({"_dims": 5, "block_": block, "pos_": pos, "id_": ids, "label_": label, "v_": list(v)})
    score = v @ v.T
    for same, most in ((True, 5), (False, 3)):
        top = [[H.MOST] if same else [int(score[k].max()) // 2, int(score[k].max()) * 19 // 20] for k in range(120)]
        low = [[H.LEAST] if same else [x // 3 for x in t] for t in top]
        asked = pd.DataFrame({"rid": pos, "home": block, "label": label, "a": list(v), "lo": low, "hi": top, "floor": low})
        got = H._best(same, own, most)(asked, rows)
        want = []
        for k in range(120):
            for lo, hi in zip(low[k], top[k], strict=True):
                can = [j for j in range(120) if (block[j] == block[k]) == own and (label[j] == label[k]) == same and not (same and j == k) and lo <= score[k, j] <= hi]
                want += [(pos[k], lo, hi, pos[j], ids[j], score[k, j]) for j in sorted(can, key=lambda j: (-score[k, j], ids[j], pos[j]))[:most]]
        assert sorted(map(tuple, got.astype(object).to_numpy())) == sorted(want)
