"""Near duplicates by 5-word shingles, against brute force, and the pipeline's stage."""

import random
from collections import Counter

import numpy as np

from caselake.llm import shingle_dedup


def weighted(text):
    w = (text or "").lower().split()
    return Counter(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    return a == b or 5 * sum((a & b).values()) >= 4 * sum((a | b).values())


def texts():
    rnd = random.Random(3)
    line = "this very common line stands at the head of many different pages here"
    out = []
    for k in range(40):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice((4, 12, 80, 200)))]
        for edits in range(rnd.randrange(1, 6)):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(1000)}"
            out.append((line + " " if k % 3 == 0 else "") + " ".join(w))
    out += ["ha " * 40, "ha " * 48, "ha " * 60, "few words", "Few  WORDS", "", " \t", None]
    rnd.shuffle(out)
    return list(enumerate(out))


def smallest(rows):
    sets, place = [weighted(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) and place[i] != place[j]:
                lo, hi = sorted((place[i], place[j]))
                place = [lo if p == hi else p for p in place]
    return dict(enumerate(place))


def test_classes_match_brute_force(spark, monkeypatch):
    rows, want = texts(), None
    want = smallest(rows)
    assert any(k != v for k, v in want.items())
    for chunk in (4096, 2):
        monkeypatch.setattr(shingle_dedup, "CHUNK", chunk)
        got = shingle_dedup.similar_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_the_stage_drops_copies_with_edited_words(spark, sf):
    import corpus_pipeline as P

    rows = texts()
    want = sorted(set(smallest(rows).values()))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 as _id", "2 as _ID_")
    got = P.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want
    assert got.filter("doc_id is null").count() == 1


def test_longer_heads_bring_more_segments():
    assert shingle_dedup.layout(10) == shingle_dedup.layout(200_000)
    head, segments = shingle_dedup.layout(10**10)
    assert head > 20 and (1 - 0.75 * 0.9**head) ** segments < 2e-3
    assert shingle_dedup.layout(10**12)[0] <= shingle_dedup.BITS and -(-shingle_dedup.layout(10**12)[1] * 23 // 64) < len(shingle_dedup._DRAW)


def test_keys_find_what_a_few_errors_leave():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        a = rnd.integers(0, 1 << 23, 21)
        b = a.copy()
        for at in rnd.integers(0, 21 * 23, 20):
            b[at // 23] ^= 1 << (at % 23)
        row, key = shingle_dedup.wide_keys(np.stack([a, b]), 8)
        assert set(key[row == 0]) & set(key[row == 1])
