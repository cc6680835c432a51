"""Conversation repair against a plain enumeration of all edits, in one range and in many."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from caselake.llm import turn_repair as T
from caselake.llm.queries import QUERIES

SPACES = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired lines) by going through every sequence of edits that costs no more than the best one known."""
    found, best = faults(rows), [(2 * len(rows), "D" * len(rows), [])]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def go(i, state, cost, audit, lines):
        if cost > best[0][0]:
            return
        if i == len(rows) and state in (0, 3):
            best[0] = min(best[0], (cost, audit, lines))
        next_role = "assistant" if state == 2 else "user"
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, state, cost + 2, audit + "D", lines)
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                if (state, role[:1]) in step:
                    go(i + 1, step[state, role[:1]], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                go(i + 1, step[state, next_role[0]], cost + more + 1, audit + "R", [*lines, f"{next_role}:{text}"])
        go(i, step[state, next_role[0]], cost + 5, audit + "I", [*lines, f"{next_role}:"])

    go(0, 0, 0, "", [])
    return best[0]


def expected(rows, order):
    """The whole report of damaged (turn, role, text) rows."""
    rows = sorted(rows, key=order)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    kinds = faults(pairs)
    cost, audit, lines = plain(pairs)
    illegal = sum(f"{a[0][:1]}{b[0][:1]}" not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out.setdefault(conv, []).extend([] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return out


def reported(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def by_turn(row):
    return (row[0] is not None, row[0] or 0)


def test_search_takes_the_least_of_the_cheapest_audits():
    rng = random.Random(5)
    for _ in range(1500):
        pairs = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", "", "d!"])) for _ in range(rng.randint(1, 6))]
        kinds = faults(pairs)
        rows = tuple((r[:1], k in ("blank", "duplicate"), k == "truncated", 1) for (r, _), k in zip(pairs, kinds, strict=True))
        cost, letters = T.search(rows, 0, T.ACCEPT, True)
        assert (cost, T.audit_of(rows, letters)) == plain(pairs)[:2], pairs


@pytest.mark.parametrize("per_range", [3, 4096])
def test_report_equals_plain_enumeration(spark, monkeypatch, per_range):
    monkeypatch.setattr(T, "PER_RANGE", per_range)
    rng, rows = random.Random(per_range), []
    for conv in [None, *range(60)]:
        for turn in [None] * (rng.random() < 0.2) + list(range(rng.randint(0, 2), rng.randint(2, 9))):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant"] * 5 + ["system", "", "tool", None]), rng.choice(["One.", "Two!", "three", " ", "", None, "Four?\n", "çé."])))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_kind", F.lit("mine")).withColumn("pos", F.lit(1))
    want = {c: expected(r, by_turn) for c, r in damaged(rows).items()}
    assert reported(T.repair_report(df)) == want


def test_a_long_conversation_spreads_over_ranges_and_agrees_with_one(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Line {t}.", f"Cut {t}", "Again."])) for t in range(600)] + [(8, None, "user", "Same.")] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    whole = reported(T.repair_report(df, damaged=False))
    monkeypatch.setattr(T, "PER_RANGE", 25)
    assert reported(T.repair_report(df, damaged=False)) == whole
    assert whole[8] == (0, 0, 299, 0, 299, 600, "D" * 300, hashlib.sha256(b"").hexdigest())
    found = T._placed(df)
    assert found.filter("conv = 7").select(F.shiftright("pos", T.RANGE_BITS)).distinct().count() > 10


def test_repaired_rows_are_in_order(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", ""), (2, 5, "user", "x" * 200_000), (2, 9, "assistant", "y.")]
    found = T.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r["conv"], r["role"], r["text"][:8], r["edit"]) for r in found.turns.orderBy("conv", "pos", "at").collect()]
    assert got == [(1, "user", "Be kind.", "R"), (1, "assistant", "Hello.", "K")]
    assert {r["conv"]: (r["audit"], r["cost"]) for r in found.report.collect()} == {1: ("RKD", 3), 2: ("DD", 4)}


def test_empty_table(spark):
    assert T.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_its_table(spark):
    d = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{d}/conversations.parquet")
    rows = [tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]
    assert reported(QUERIES["op11_repair_turns"](spark, d)) == {c: expected(r, by_turn) for c, r in damaged(rows).items()}
