"""Repair of conversations: the cheapest edits that make turns alternate, by bidirectional Dijkstra.

A conversation is in order if its roles are nothing, or an optional system turn and then pairs
of user and assistant. Rows are kept (0), given another role (1), deleted (2), or empty ones
inserted (5); what must be deleted is, and a row that is cut short costs 5 if it stays. The
nodes of the lattice are (rows done, state of the order). One heap searches from the start,
one from the ends; when their tops add up to more than the best crossing, every node of
every cheapest path is settled by one of them, and so all equal-cost crossings are. The walk
along them takes the least letter at each node: of two audits of equal cost none begins
with the other, so that gives the least audit.

Conversations are cut into ranges of rows. One that lies in a range is solved there. A longer
one gives, for each range, the cost and the order of audits between all states at its two
ends; a chain over these few numbers picks the states, and then each range is solved by
itself. No task holds more than a range of rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut

#: Rows in a range, about.
PER_RANGE = 4096
KEEP, RENAME, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
NO_COST = 1 << 60
#: States: nothing yet, after system, after user, after assistant. What each letter leads to.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPT = (0, 3)
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: Conversations of so many rows at most are remembered by their pattern.
SHORT = 24

Row = tuple[str, bool, bool, int]  # first letter of the role, must be deleted, is cut short, copies


@lru_cache(4096)
def _edges(row: Row) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """From each state, the (letter, cost, state) of what can be done with a row; further copies are deleted."""
    initial, forced, short, copies = row
    more, out = DELETE * (copies - 1), []
    for state in range(4):
        edges = [("D", DELETE + more, state)]
        if not forced:
            stay = more + (CUT_SHORT if short else 0)
            kept = AFTER.get(initial, {}).get(state)
            if kept is not None:
                edges.append(("K", KEEP + stay, kept))
            if kept != NEXT[state]:
                edges.append(("R", RENAME + stay, NEXT[state]))
        out.append(tuple(edges))
    return tuple(out)


def search(rows: tuple[Row, ...], entry: int, goals: tuple[int, ...], closed: bool) -> tuple[int, tuple[str, ...]]:
    """(cost, letters) of the least audit among the cheapest from `entry` before the rows to one of `goals` after them.

    Rows are inserted before a row, and behind the last one only if `closed`. Letters are one
    for each step. Without a way the cost is `NO_COST`.
    """
    n = len(rows)

    def ahead(node: int) -> list[tuple[str, int, int]]:
        i, state = divmod(node, 4)
        out = [("I", INSERT, 4 * i + NEXT[state])] if i < n or closed else []
        if i < n:
            out += [(letter, cost, 4 * i + 4 + to) for letter, cost, to in _edges(rows[i])[state]]
        return out

    def behind(node: int) -> list[tuple[str, int, int]]:
        i, state = divmod(node, 4)
        out = [("I", INSERT, 4 * i + s) for s in range(4) if NEXT[s] == state] if i < n or closed else []
        if i:
            out += [(letter, cost, 4 * i - 4 + s) for s, edges in enumerate(_edges(rows[i - 1])) for letter, cost, to in edges if to == state]
        return out

    tops = ([(0, entry)], [(0, 4 * n + g) for g in goals])
    cost: tuple[dict[int, int], dict[int, int]] = ({entry: 0}, {g: 0 for _, g in tops[1]})
    settled: tuple[set[int], set[int]] = (set(), set())
    best = min((c + cost[1][v] for v, c in cost[0].items() if v in cost[1]), default=NO_COST)
    for heap in tops:
        heapq.heapify(heap)
    while tops[0] and tops[1] and tops[0][0][0] + tops[1][0][0] <= best:
        side = 0 if tops[0][0][0] <= tops[1][0][0] else 1
        c, node = heapq.heappop(tops[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        for _, step, other in (ahead, behind)[side](node):
            if c + step < cost[side].get(other, NO_COST):
                cost[side][other] = c + step
                heapq.heappush(tops[side], (c + step, other))
                if other in cost[1 - side]:
                    best = min(best, c + step + cost[1 - side][other])
    if best == NO_COST:
        return NO_COST, ()
    front, back = cost
    # Forward nodes that lie on a cheapest path: from each crossing back along tight edges.
    on = {u for u in settled[0] if any(v in settled[1] and front[u] + step + back[v] == best for _, step, v in ahead(u))}
    ends = {4 * n + g for g in goals}
    on |= {u for u in settled[0] & (settled[1] | ends) if front[u] + back[u] == best}
    stack = list(on)
    while stack:
        v = stack.pop()
        for _, step, u in behind(v):
            if u in settled[0] and u not in on and front[u] + step == front[v]:
                on.add(u)
                stack.append(u)
    node, letters, spent = entry, [], 0
    while node not in ends or spent != best:
        options = []
        for letter, step, v in ahead(node):
            forward = v in on and front[v] == spent + step
            backward = v in settled[1] and spent + step + back[v] == best
            if forward or backward:
                options.append((letter, step, v))
        letter, step, node = min(options)
        spent += step
        letters.append(letter)
    return best, tuple(letters)


_remembered = lru_cache(200_000)(search)


def cheapest(rows: tuple[Row, ...], entry: int, goals: tuple[int, ...], closed: bool) -> tuple[int, tuple[str, ...]]:
    return (_remembered if len(rows) <= SHORT else search)(rows, entry, goals, closed)


def audit_of(rows: tuple[Row, ...], letters: tuple[str, ...]) -> str:
    """The letters with those of further copies, which are deleted behind their row."""
    out, i = [], 0
    for letter in letters:
        out.append(letter)
        if letter != "I":
            out.append("D" * (rows[i][3] - 1))
            i += 1
    return "".join(out)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its role user. Nulls: one space in role, text and the crc's text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    d = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


class Repair:
    """What `repair` finds: `turns` (conv, pos, at, role, text, edit: the repaired rows in order of pos and at) and `report` (conv, gaps, blank, duplicate, truncated, illegal, cost, audit)."""

    def __init__(self, turns: DataFrame, report: DataFrame):
        self.turns, self.report = turns, report


def _placed(rows: DataFrame) -> DataFrame:
    """Rows, equal ones as one with `copies`, with their faults and `pos`: their place in the order, range by range."""
    t = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    t = t.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    again = t.groupBy(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t")).agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    t = t.join(again, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t")), "left")
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    t = t.withColumns({"blank": last == "", "seen": F.coalesce(~F.col("_first.turn").eqNullSafe(F.col("turn")), F.lit(False)) & F.col("_first").isNotNull(), "short": ~last.isin(".", "!", "?")})
    t = t.withColumns({"initial": F.substring("role", 1, 1), "tie": F.xxhash64("role", "text")}).drop("_c", "_r", "_t", "_first")
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("tie")]
    ranges = max(1, -(-rows.count() // PER_RANGE))
    ranged = t.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "role", "text")
    return cut(ranged.withColumn("pos", F.monotonically_increasing_id()))


#: The high bits of a place number its range.
RANGE_BITS = 33
BORDER = "part long, conv string, named boolean, final string, costs array<long>, ranks array<int>, ends array<long>"
CHOICE = "part long, conv string, named boolean, entry int, exit int, closed boolean, previous string"
EDITS = "pos long, audit string, cost long, illegal long, roles array<string>"


def _blocks(group: pd.DataFrame) -> Iterator[tuple[str | None, bool, pd.DataFrame, tuple[Row, ...]]]:
    group = group.sort_values("pos")
    keys = list(zip(group["named"].tolist(), group["conv"].tolist(), strict=True))
    begins = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
    for a, b in zip(begins, begins[1:], strict=False):
        part = group.iloc[a:b]
        rows = tuple(zip(part["initial"].tolist(), part["forced"].tolist(), part["short"].tolist(), (int(c) for c in part["copies"]), strict=True))
        yield keys[a][1], keys[a][0], part, rows


def _border(group: pd.DataFrame) -> pd.DataFrame:
    """Of a range's first and last conversation: the costs and the order of the audits between all states, and the costs to its end if it is the last part."""
    blocks, out = list(_blocks(group)), []
    for k, (conv, named, part, rows) in enumerate(blocks):
        if k not in (0, len(blocks) - 1):
            continue
        found = [[search(rows, e, (x,), False) for x in range(4)] for e in range(4)]
        ranks = []
        for row in found:
            audits = sorted(audit_of(rows, letters) for c, letters in row if c < NO_COST)
            ranks += [audits.index(audit_of(rows, letters)) if c < NO_COST else 4 for c, letters in row]
        ends = [search(rows, e, ACCEPT, True)[0] for e in range(4)]
        out.append((int(group["part"].iat[0]), conv, named, rows[-1][0], [c for row in found for c, _ in row], ranks, ends))
    return pd.DataFrame(out, columns=["part", "conv", "named", "final", "costs", "ranks", "ends"])


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """The state at which each range of one conversation begins and ends, so that the whole is cheapest and its audit the least."""
    group = group.sort_values("part")
    blocks = list(group.itertuples(index=False))
    left = [[0] * 4 for _ in blocks]
    left[-1] = [int(c) for c in blocks[-1].ends]
    for k in range(len(blocks) - 2, -1, -1):
        left[k] = [min(int(blocks[k].costs[4 * e + x]) + left[k + 1][x] for x in range(4)) for e in range(4)]
    state, out = 0, []
    for k, b in enumerate(blocks):
        previous = blocks[k - 1].final if k else None
        if k == len(blocks) - 1:
            out.append((b.part, b.conv, b.named, state, -1, True, previous))
            break
        ways = [(int(b.ranks[4 * state + x]), x) for x in range(4) if int(b.costs[4 * state + x]) + left[k + 1][x] == left[k][state]]
        to = min(ways)[1]
        out.append((b.part, b.conv, b.named, state, to, False, previous))
        state = to
    return pd.DataFrame(out, columns=["part", "conv", "named", "entry", "exit", "closed", "previous"])


def _solved(group: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """Each row's part of the audit, its cost, the illegal steps up to it, and the roles of what it becomes; an empty role stands for the row itself where it keeps its own."""
    picks = {(bool(c.named), c.conv): c for c in chosen.itertuples(index=False)}
    out: dict[str, list] = {"pos": [], "audit": [], "cost": [], "illegal": [], "roles": []}
    for conv, named, part, rows in _blocks(group):
        pick = picks.get((bool(named), conv))
        entry, goals, closed, before = (int(pick.entry), ACCEPT if pick.closed else (int(pick.exit),), bool(pick.closed), pick.previous) if pick is not None else (0, ACCEPT, True, None)
        _, letters = cheapest(rows, entry, goals, closed)
        state, at = entry, 0
        audits, costs, roles = [[] for _ in rows], [0] * len(rows), [[] for _ in rows]
        for letter in letters:
            k = min(at, len(rows) - 1)  # what is inserted behind all rows goes with the last one
            audits[k].append(letter)
            if letter == "I":
                state = NEXT[state]
                costs[k] += INSERT
                roles[k].append(ROLE[state])
                continue
            _, step, to = next(e for e in _edges(rows[at])[state] if e[0] == letter)
            costs[k] += step
            audits[k].append("D" * (rows[at][3] - 1))
            if letter != "D":
                roles[k].append("" if letter == "K" else f"={ROLE[to]}")
            state, at = to, at + 1
        for k, (initial, _, _, copies) in enumerate(rows):
            steps = copies - 1 + (before is not None and f"{before}{initial}" not in ("su", "ua", "au"))
            before = initial
            out["illegal"].append(steps)
        out["pos"] += part["pos"].tolist()
        out["audit"] += ["".join(a) for a in audits]
        out["cost"] += costs
        out["roles"] += roles
    return pd.DataFrame(out)


def repair(rows: DataFrame) -> Repair:
    """The cheapest repair of each conversation of `rows` (conv_id, turn, role, text; further columns are left aside).

    A conversation's rows are taken by turn, nulls first, equal turns in a fixed order of role
    and text. Null roles and texts count as one space; a null conv_id is a conversation of
    its own. A row's first fault counts: blank (no character but ASCII space), duplicate (role
    and text seen earlier), truncated (the last such character is none of `.!?`). Blank
    and duplicate rows are deleted. No rows, no result; very long texts never enter Python.
    """
    placed = _placed(rows)
    small = placed.select(
        F.shiftright("pos", RANGE_BITS).alias("part"), "pos", F.col("conv").cast("string").alias("conv"), F.col("conv").isNotNull().alias("named"), "initial",
        (F.col("blank") | F.col("seen")).alias("forced"), "short", "copies",
    )
    borders = small.groupBy("part").applyInPandas(_border, BORDER)
    chosen = borders.groupBy("named", "conv").applyInPandas(_chain, CHOICE)
    edits = cut(small.groupBy("part").cogroup(chosen.groupBy("part")).applyInPandas(_solved, EDITS))
    both = placed.join(edits, "pos")

    made = both.select("conv", "pos", "text", F.col("role").alias("_role"), F.posexplode("roles").alias("at", "_as"))
    own = (F.col("_as") == "") | F.col("_as").startswith("=")
    turns = made.select(
        "conv", "pos", "at", F.when(F.col("_as") == "", F.col("_role")).otherwise(F.regexp_replace("_as", "^=", "")).alias("role"),
        F.when(own, F.col("text")).otherwise("").alias("text"), F.when(F.col("_as") == "", "K").when(own, "R").otherwise("I").alias("edit"),
    )

    part = F.shiftright("pos", RANGE_BITS)
    seen, n = F.col("seen"), F.col("copies")
    slim = placed.select("conv", "turn", "pos", "blank", "seen", "short", "copies").join(edits.select("pos", "audit", "cost", "illegal"), "pos")
    pieces = slim.groupBy("conv", part.alias("_part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "audit"))), lambda x: x["audit"]), "").alias("_audit"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(F.when(~F.col("blank"), F.when(seen, n).otherwise(n - 1)).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~seen & F.col("short"), 1).otherwise(0)).alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
    )
    whole = pieces.groupBy("conv").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_audit"))), lambda x: x["_audit"]), "").alias("audit"),
    )
    gaps = slim.select(F.col("conv").alias("_of"), "turn").distinct().groupBy("_of").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    report = whole.join(gaps, F.col("conv").eqNullSafe(F.col("_of"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(turns, report)


def text_digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of each conversation's `role:text`, joined by newlines. A hash goes along the whole text, so a task reads a conversation's rows in order, a batch at a time, and holds none."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for batch in batches:
            done = []
            for key, conv, line in zip(batch["key"], batch["_conv"], batch["line"], strict=True):
                if now is None or key != now[0]:
                    if now is not None:
                        done.append((now[1], digest.hexdigest()))
                    now, digest = (key, conv), hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pd.DataFrame(done, columns=["_conv", "repaired_sha256"])
        if now is not None:
            yield pd.DataFrame([(now[1], digest.hexdigest())], columns=["_conv", "repaired_sha256"])

    kind = StructType([turns.schema["conv"]]).fields[0].dataType.simpleString()
    lines = turns.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("key"), F.col("conv").cast("string").alias("_conv"), "pos", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    key = F.concat(F.col("_conv").isNull().cast("string"), F.lit(":"), "key")
    lines = lines.withColumn("key", key).repartition("key").sortWithinPartitions("key", "pos", "at")
    found = lines.mapInPandas(hashed, "_conv string, repaired_sha256 string")
    return found.select(F.col("_conv").cast(kind).alias("conv"), "repaired_sha256")


def repair_report(conversations: DataFrame, damaged: bool = True) -> DataFrame:
    """One row per conv_id of `conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after `damage` unless told not to. A conversation that lost all rows has zeros, an empty audit and the hash of the empty string."""
    rows = damage(conversations) if damaged else conversations
    found = repair(rows)
    report, digests = found.report, text_digests(found.turns).withColumnRenamed("conv", "_conv")
    out = conversations.select("conv_id").distinct()
    out = out.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
