"""Behaviour that the driver's tables do not show: edge cases and properties."""

import hashlib
import hmac as hm
import random

import pytest
from pyspark.sql import functions as F

from caselake.operators import intervals, lanes, linkage, maintain, sequence, triage

CAT = "id string, source_path string, sha256 string, size_bytes long"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_compare_matrix(spark):
    a = spark.createDataFrame([("1", "p1", "H1", 1), ("2", "p2", "h2", 1), ("3", "p3", None, 5), ("4", "p4", "dd", 1), ("5", "p5", "dd", 1), ("6", "p6", None, 1)], CAT)
    b = spark.createDataFrame([("a", "moved", "h1", 1), ("b", "p2", "hx", 1), ("c", "p3", "h3", 5), ("d", "p4", "DD", 1), ("e", "p6", None, 2)], CAT)
    got = rows(linkage.compare_catalogs(a, b), "relation", "a_id", "b_id")
    assert got == sorted([("both", "1", "a"), ("hash_mismatch_same_path", "2", "b"), ("both", "3", "c"), ("both", "4", "d"), ("only_a", "5", None), ("only_a", "6", None), ("only_b", None, "e")], key=repr)


def test_compare_parts_both_sides(spark):
    rnd = random.Random(1)
    side = lambda p: [(f"{p}{i}", f"path{rnd.randrange(30)}", rnd.choice([None, *map(str, range(12))]), rnd.randrange(3)) for i in range(60)]
    a, b = side("a"), side("b")
    got = linkage.compare_catalogs(spark.createDataFrame(a, CAT), spark.createDataFrame(b, CAT)).collect()
    for p, all_ in (("a_id", a), ("b_id", b)):
        assert sorted(r[p] for r in got if r[p]) == sorted(x[0] for x in all_)


def test_unhashed_is_neither(spark):
    c = spark.createDataFrame([("1", "A" * 64), ("2", None), ("3", ""), ("4", "b" * 64)], "id string, sha256 string")
    h = spark.createDataFrame([("a" * 64,), ("a" * 64,)], "sha256 string")
    assert rows(linkage.known_hash_split(c, h), "id", "hash_class") == [("1", "known"), ("2", "unhashed"), ("3", "unhashed"), ("4", "unknown")]


def test_accuracy_of_nothing_is_one(spark):
    e = spark.createDataFrame([], "source_path string, sha256 string")
    assert rows(linkage.accuracy(e, e)) == [(0, 0, 0, 0, 1.0, 1.0, True)]


def test_merge_catalog_is_stable(spark):
    schema = "path_key string, id string, source_path string, size_bytes long, modified_unix long, sha256 string, stale boolean, stale_since long"
    old = spark.createDataFrame([("p", "v1", "p", 1, 1, None, False, None), ("q", "v2", "q", 1, 1, None, True, 5), ("p", "v0", "P", 1, 1, None, False, None)], schema)
    now = old.limit(0)
    gone = spark.createDataFrame([("p", "missing"), ("q", "missing")], "path_key string, state string")
    once = linkage.merge_catalog(old, now, gone, 9)
    assert rows(once, "path_key", "id", "stale", "stale_since") == [("p", "v1", True, 9), ("q", "v2", True, 5)]
    assert rows(linkage.merge_catalog(once, now, gone, 99)) == rows(once)


def test_frame_gap_reset(spark):
    f = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 1, None), (1, 0, 2, 100), (1, 0, 3, 101), (1, 0, 4, 99), (1, 0, 5, 102)], "file int, channel int, offset long, seconds long")
    assert rows(sequence.frame_gap_findings(f), "offset", "kind", "delta") == [(1, "invalid-date", None), (4, "regression", -2), (5, "gap", 3)]


def test_order_basis(spark):
    s = spark.createDataFrame([("g", 1, 5), ("g", None, 6), ("h", 1, None), ("i", None, None)], "group string, name_s long, created_s long")
    assert rows(sequence.order_basis(s), "group", "basis", "order_s") == [("g", "created", 5), ("g", "created", 6), ("h", "name", 1), ("i", "natural", None)]


def test_free_regions_and_intervals_make_the_whole(spark):
    rnd = random.Random(3)
    spans = [(a := rnd.randrange(0, 9000), a + rnd.randrange(1, 900)) for _ in range(15)]
    c = spark.createDataFrame([("i", a, b) for a, b in spans], "image string, start_b long, end_b long")
    free = intervals.free_regions(c, spark.createDataFrame([("i", 12000)], "image string, size long"), least=1)
    bytes_ = {x for a, b in spans for x in range(a, b)}
    assert {x for r in free.collect() for x in range(r["start_b"], r["end_b"])} == set(range(12000)) - bytes_
    whole = intervals.uncovered(spark.createDataFrame([("i", 1, 0, 12000)], "image string, span long, start_b long, end_b long"), c, size=500)
    assert {x for r in whole.collect() for x in range(r["start_b"], r["end_b"])} == set(range(12000)) - bytes_


def chain(n, key=None, lane="l"):
    out, head = [], "GENESIS"
    for i in range(n):
        signed = f'{{"n":{i},"previous_entry_sha256":"{head}"}}'
        tail = f',"entry_sha256":"{hashlib.sha256(signed.encode()).hexdigest()}"'
        if key:
            tail += f',"entry_hmac_sha256":"{hm.new(bytes.fromhex(key), signed.encode(), hashlib.sha256).hexdigest()}","entry_hmac_key_id":"k1"'
        out.append(signed[:-1] + tail + "}")
        head = hashlib.sha256(out[-1].encode()).hexdigest()
    return out


TAMPERED = {
    "none": (lambda x: x, "intact", None),
    "byte": (lambda x: [*x[:2], x[2].replace('"n":2', '"n":7'), *x[3:]], "broken", 3),
    "dropped": (lambda x: x[:2] + x[3:], "broken", 3),
    "swapped": (lambda x: [x[0], x[2], x[1], *x[3:]], "broken", 2),
    "blank": (lambda x: [*x, ""], "broken", 6),
    "trailing": (lambda x: [*x[:4], x[4][:-1] + ',"z":1}'], "broken", 5),
    "moved-field": (lambda x: [*x[:1], x[1].replace('{"n":1,', "{").replace('","entry_sha', '","n":1,"entry_sha'), *x[2:]], "broken", 2),
    "cut-tail": (lambda x: x[:3], "intact", None),
}


def lines(spark, per_lane):
    return spark.createDataFrame([(k, i + 1, raw) for k, ls in per_lane.items() for i, raw in enumerate(ls)], "lane string, line_no long, raw string")


def test_tampering(spark):
    df = lines(spark, {k: f(chain(5)) for k, (f, *_) in TAMPERED.items()})
    got = {r["lane"]: (r["status"], r["first_bad"]) for r in lanes.verify_chain(df).collect()}
    assert got == {k: (s, n) for k, (_, s, n) in TAMPERED.items()}


def test_any_edited_byte_breaks_the_chain(spark):
    good, rnd, tampered = chain(4), random.Random(7), {}
    for k in range(60):
        at, pos = rnd.randrange(4), rnd.randrange(len(good[0]) - 2)
        line = good[at]
        tampered[f"{k}"] = [*good[:at], line[:pos] + ("x" if line[pos] != "x" else "y") + line[pos + 1 :], *good[at + 1 :]]
    assert all(r["status"] == "broken" for r in lanes.verify_chain(lines(spark, tampered)).collect())


def test_trust(spark):
    key, other = "11" * 32, "22" * 32
    mixed = chain(4, key)
    mixed[3] = mixed[3].split(',"entry_hmac')[0] + "}"
    df = lines(spark, {"plain": chain(2), "keyed": chain(2, key), "foreign": chain(2, other), "stripped": mixed})
    got = {(r["lane"], r["line_no"]): r["trust"] for r in lanes.line_trust(df, {"k2": key}).collect()}
    assert got[("plain", 1)] == "not-authenticated" and got[("keyed", 2)] == "authenticated" and got[("foreign", 1)] == "other-key"
    assert got[("stripped", 3)] == "authenticated" and got[("stripped", 4)] == "not-authenticated"
    refuted = {r["trust"] for r in lanes.line_trust(df.filter("lane = 'foreign'"), {"k1": key}).collect()}
    assert refuted == {"chain-broken"}
    assert {r["trust"] for r in lanes.line_trust(df, {}).collect()} == {"self-consistent"}


def test_a_changed_trailer_breaks_the_next_line(spark):
    good = chain(3, "11" * 32)
    unsigned = [good[0].split(',"entry_hmac')[0] + "}", *good[1:]]
    got = lanes.verify_chain(lines(spark, {"l": unsigned})).first()
    assert (got["first_bad"], got["reason"]) == (2, "previous-hash-mismatch")


def test_a_failed_lane_holds_all_anchors(spark):
    df = lines(spark, {"a": chain(3), "b": chain(4)})
    heads, trust = lanes.verify_chain(df), lanes.line_trust(df, {})
    entry = {r["lane"]: r["head"] for r in heads.collect()}
    move = lambda *anchors: rows(lanes.advance_anchors(heads, trust, spark.createDataFrame(anchors, "lane string, entries long, head string")), "lane", "entries", "integrity")
    assert move(("a", 1, "x")) == [("a", 3, "self-consistent"), ("b", 4, "self-consistent")]
    for bad in (("b", 5, "x"), ("b", 4, "x"), ("c", 1, "x")):
        assert move(("a", 1, "x"), bad) == sorted([("a", 1, "unchanged"), (bad[0], bad[1], "unchanged")])
    assert move(("b", 4, entry["b"])) == [("a", 3, "self-consistent"), ("b", 4, "self-consistent")]


STATE = "id string, status string, note string, revision long, client_id string, deleted boolean"
PATCH = "id string, base_revision long, client_id string, delete boolean, status string, note string"


@pytest.mark.parametrize("patch,want,conflicts,history", [
    (("a", 2, "c2", False, "x", None), ("s", 3, "c1", False), 1, 0),
    (("a", 3, "c2", False, "x", None), ("x", 4, "c2", False), 0, 1),
    (("a", 9, "c2", False, "x", None), ("s", 3, "c1", False), 1, 0),
    (("a", 2, "c1", False, "x", None), ("x", 4, "c1", False), 0, 1),
    (("a", 3, "c2", False, "s", "n"), ("s", 3, "c1", False), 0, 0),
    (("a", 3, "c2", True, None, None), (None, 4, "c2", True), 0, 1),
])
def test_patch(spark, patch, want, conflicts, history):
    new, c, h = maintain.apply_patch(spark.createDataFrame([("a", "s", "n", 3, "c1", False)], STATE), spark.createDataFrame([patch], PATCH))
    assert rows(new, "status", "revision", "client_id", "deleted") == [want]
    assert (c.count(), h.count()) == (conflicts, history)


def test_stale_recreate_after_delete_conflicts(spark):
    state = spark.createDataFrame([("a", None, None, 4, "c2", True)], STATE)
    new, c, _ = maintain.apply_patch(state, spark.createDataFrame([("a", 3, "c1", False, "x", None)], PATCH))
    assert c.count() == 1 and rows(new, "deleted") == [(True,)]
    new, c, _ = maintain.apply_patch(state, spark.createDataFrame([("a", 4, "c1", False, "x", None)], PATCH))
    assert c.count() == 0 and rows(new, "status", "revision", "deleted") == [("x", 5, False)]


def test_source_registry(spark):
    schema = "seq int, kind string, path string, custodian string, note string, auto_note boolean, hash string, algorithm string, computed boolean"
    reg = spark.createDataFrame([
        (1, "disk", "p", "ann", "by hand", False, None, None, False), (2, "disk", "p", "bob", "auto", True, "a" * 64, "sha256", True),
        (3, "disk", "p", None, None, True, "b" * 64, "sha256", False), (4, "disk", "p", None, None, True, "b" * 63, "sha256", False),
    ], schema)
    got, changes, errors = maintain.source_registry(reg)
    assert rows(got, "custodian", "note", "hash") == [("bob", "by hand", "a" * 64)]
    assert rows(changes, "seq", "was", "now") == [(2, "ann", "bob")] and errors.count() == 1
    assert got.first()["source_id"].startswith("src_") and len(got.first()["source_id"]) == 20


def test_self_merge_is_refused(spark):
    t = spark.createDataFrame([("vid_000001", "p", None)], "id string, path_key string, sha256 string")
    with pytest.raises(ValueError):
        maintain.merge_cases(t, [("x", t)])


def test_loudness_and_silence(spark):
    inf = float("-inf")
    b = spark.createDataFrame([("a", 100, -20.0, -30.0), ("a", 300, -10.0, -20.0), ("s", 10, inf, inf), ("e", 0, None, None)], "id string, n_samples long, max_db double, mean_db double")
    got = {r["id"]: (r["peak_db"], r["mean_db"] and round(r["mean_db"], 3), r["state"]) for r in triage.loudness(b, ["id"]).collect()}
    assert got == {"a": (-10.0, -21.107, "measured"), "s": (inf, inf, "measured"), "e": (None, None, "error")}


def test_run_result_reasons(spark):
    e = "lane string, line_no long, run_id string, is_marker boolean, usable boolean, is_repair boolean, ts long"
    df = spark.createDataFrame([("a", 1, "r1", False, True, False, 5), ("a", 2, "r1", True, True, False, 5), ("b", 1, "r1", True, True, False, 9999), ("b", 2, "r2", False, True, False, 5), ("b", 3, None, False, False, True, 5), ("c", 1, "r1", False, True, False, 5)], e)
    got = {r["lane"]: (r["run_id"], r["reasons"], r["clock_anomaly"]) for r in lanes.run_result(df, 0).collect()}
    assert got == {"a": ("r1", [], False), "b": ("r1", ["newer-unfinished-run", "unusable-after-marker", "repair-after-marker"], True)}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], CAT + ", parent_dir string, modified_unix long")
    assert linkage.compare_catalogs(none, none).count() == 0 and sequence.timestamp_findings(none).count() == 0
    assert sequence.mark_duplicates(none, ["id"]).count() == 0
    assert triage.facet_counts(none, {"id": None}).count() == 0


def test_set_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "2"), ("h", "1"), ("h", "1"), ("i", "3")], "g string, v string")
    got = {r["g"]: r["digest"] for r in triage.set_fingerprint(a, "g", "v").collect()}
    assert got["g"] == got["h"] != got["i"]


def test_search_stays_within_a_field(spark):
    r = spark.createDataFrame([("ab", "cd")], "id string, note string")
    assert triage.search(r, "BC").count() == 0 and triage.search(r, "AB").count() == 1


def test_page_keys(spark):
    r = spark.range(20).select(F.format_string("k%02d", "id").alias("k"))
    assert [x["k"] for x in triage.page_after(r, "k", "k04", 2).collect()] == ["k05", "k06"]


def test_ids_grow_beyond_six_digits(spark):
    old = spark.createDataFrame([("p0", "vid_999998"), ("q", "vid_12")], "path_key string, id string")
    new = spark.createDataFrame([("p0",), *[(f"n{k:02d}",) for k in range(14)]], "path_key string")
    for per in (3, 500_000):
        got = dict(rows(sequence.assign_ids(new, old, per)))
        assert got == {"p0": "vid_999998", **{f"n{k:02d}": f"vid_{999_999 + k:06d}" for k in range(14)}}
    old = spark.createDataFrame([("p0", "vid_9999999999")], "path_key string, id string")
    assert dict(rows(sequence.assign_ids(new, old)))["n00"] == "vid_10000000000"


def test_a_measurement_is_not_replaced_by_a_less_trusted_one(spark):
    schema = "selector string, lane string, line_no long, is_repair boolean, trust string, ts long, value long"
    latest = lambda *es: rows(lanes.measurement_latest(spark.createDataFrame([("s", *e) for e in es], schema)), "line_no", "trust", "value")
    good, later = ("a", 5, False, "authenticated", 50, 1), ("a", 9, False, "self-consistent", 90, 2)
    assert latest(good, later) == [(5, "authenticated", 1)]
    assert latest(good, ("a", 9, False, "unverified", 90, 2)) == [(9, "unverified", 2)]
    assert latest(good, ("b", 9, False, "unverified", 90, 2)) == [(5, "authenticated", 1)]
    assert latest(good, later, ("b", 1, False, "authenticated", 95, 3)) == [(1, "authenticated", 3)]
    assert latest(good, ("a", 6, True, "authenticated", 60, 0), later) == [(9, "self-consistent", 2)]


def test_unknown_chips_are_errors(spark):
    none = spark.createDataFrame([], "id string, status string, tags array<string>")
    with pytest.raises(ValueError, match="unknown chip"):
        triage.chip_filter(none, none, none, "anomally")


def test_track_summary_is_cut_at_its_cap(spark):
    points = spark.createDataFrame([("f", k, 100 + k, float(k)) for k in range(5)], "file string, offset long, ts long, speed double")
    assert rows(triage.track_summary(points, cap=3)) == [("f", 3, 5, True, 100, 102, 2.0)]


def test_release_gate(spark):
    states = lambda *s: spark.createDataFrame([(x,) for x in s], "state string")
    speed = lambda rows_, ms: spark.createDataFrame([(rows_, ms)], "rows long, elapsed_ms long")
    none = spark.createDataFrame([], "id string")
    good = {"missing_artifacts": none, "accuracy": spark.sql("SELECT true AS passed"), "reproducibility": spark.sql("SELECT true AS reproducible"), "performance": speed(100, 0), "audit_chain": states("intact"), "consistency": none}
    verdicts = lambda **kw: dict(rows(triage.release_gate(**kw)))
    assert set(verdicts(**good).values()) == {"PASS"} and len(verdicts(**good)) == 7
    assert verdicts(**{**good, "accuracy": None}) | {"x": 0} == {**verdicts(**good), "accuracy": "BLOCKED", "overall": "BLOCKED", "x": 0}
    got = verdicts(missing_artifacts=spark.range(1), performance=speed(49_999, 60_000), audit_chain=states())
    assert got == {"report_defense": "FAIL", "performance": "FAIL", "audit_chain": "FAIL", "accuracy": "BLOCKED", "reproducibility": "BLOCKED", "consistency": "BLOCKED", "overall": "FAIL"}
