"""Tamper-evident logs: hash chains, trust of lines, current entries, completed runs, anchors."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .scans import running

GENESIS = "GENESIS"
#: A line, from its first byte to its last: the signed part, the entry's hash and, in keyed lanes, the HMAC and its key.
LINE = r'(.*),"entry_sha256":"([^"]*)"(?:,"entry_hmac_sha256":"([^"]*)","entry_hmac_key_id":"([^"]*)")?\}'
#: What the signed part ends with.
CHAINED = r'.*,"previous_entry_sha256":"([^"]*)"'


def whole_text(pattern: str) -> str:
    """The pattern for Spark's regular expressions, over the whole text: `.` takes line ends of all kinds, and nothing may follow, a carriage return neither."""
    return rf"(?s)\A{pattern}\z"


def parse_lines(lines: DataFrame) -> DataFrame:
    """lane, line_no, raw with signed (the bytes under the hash), previous, entry, hmac, key_id; null where the line has no such part."""
    part = lambda k: F.nullif(F.regexp_extract("raw", whole_text(LINE), k), F.lit(""))
    out = lines.withColumns({"_head": part(1), "entry": part(2), "hmac": part(3), "key_id": part(4)})
    out = out.withColumns({"signed": F.concat("_head", F.lit("}")), "previous": F.nullif(F.regexp_extract("_head", whole_text(CHAINED), 1), F.lit(""))})
    return out.drop("_head")


def verify_chain(lines: DataFrame, torn: DataFrame | None = None) -> DataFrame:
    """One row per lane: entries, first_bad (line), reason, status (intact, torn-tail, broken).

    Each line holds the hash of its own signed bytes and that of the whole line before, so lines
    are checked in parallel: line n is joined to line n - 1 of its lane, and no lane is sorted
    in one task. A line counts from its first byte to its last: blanks, a carriage return or
    anything else behind the closing brace break it, as no hash covers them. `torn` lists lanes
    whose last line has no line end.
    """
    p = parse_lines(lines)
    before = p.select(F.col("lane").alias("_lane"), (F.col("line_no") + 1).alias("_next"), F.sha2("raw", 256).alias("_expected"))
    j = p.join(before, (F.col("lane") == F.col("_lane")) & (F.col("line_no") == F.col("_next")), "left")
    expected = F.when(F.col("line_no") == 1, GENESIS).otherwise(F.col("_expected"))
    reason = (
        F.when(F.col("raw").rlike(r"(?U)\A\s*\z"), "blank-line")
        .when(F.col("entry").isNull(), "entry-hash-misplaced")
        .when(F.col("previous").isNull(), "previous-hash-misplaced")
        .when(~F.col("previous").eqNullSafe(expected), "previous-hash-mismatch")
        .when(F.sha2(F.col("signed"), 256) != F.col("entry"), "entry-hash-mismatch")
    )
    bad = j.withColumn("reason", reason)
    out = bad.groupBy("lane").agg(F.count("*").alias("entries"), F.min(F.when(F.col("reason").isNotNull(), F.struct("line_no", "reason"))).alias("_b"), F.max_by("entry", "line_no").alias("head"))
    out = out.select("lane", "entries", "head", F.col("_b.line_no").alias("first_bad"), F.col("_b.reason").alias("reason"))
    if torn is not None:
        out = out.join(torn.select("lane").distinct().withColumn("_torn", F.lit(True)), "lane", "left")
    else:
        out = out.withColumn("_torn", F.lit(None).cast("boolean"))
    status = F.when(F.col("first_bad").isNotNull(), "broken").when(F.col("_torn"), "torn-tail").otherwise("intact")
    return out.withColumn("status", status).drop("_torn")


#: The generation of a key that is in use; retired keys have the time of their retirement.
IN_USE = (1 << 63) - 1


def check_hmac(parsed: DataFrame, keys: dict[str, str], retired: dict[str, int] | None = None) -> DataFrame:
    """`parsed` with hmac_state, generation and key_ids.

    hmac_state: none, verified, mismatch (a key held under that name refutes it) or unknown-key.
    generation and key_ids: of the key that verifies. `keys`: hex keys by id, the keyring of
    this reader; the id "default" names no particular key. `retired`: when keys were retired, by
    id; a secret that was retired under one id is retired under all.
    """
    secrets: dict[str, tuple[list[str], int]] = {}
    for name, secret in keys.items():
        names, until = secrets.get(secret.lower(), ([], IN_USE))
        secrets[secret.lower()] = ([*names, name], min(until, (retired or {}).get(name, IN_USE)))

    @F.pandas_udf("hmac_state string, generation long, key_ids array<string>")
    def state(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ring = [(bytes.fromhex(secret), names, until) for secret, (names, until) in secrets.items()]
        for signed, tag, key_id in batches:
            out = []
            for s, t, k in zip(signed, tag, key_id, strict=True):
                if t is None or s is None:
                    out.append(("none", None, None))
                    continue
                good = next(((names, until) for key, names, until in ring if hmac.compare_digest(hmac.new(key, s.encode(), hashlib.sha256).hexdigest(), t)), None)
                out.append(("verified", good[1], good[0]) if good else ("mismatch" if k in keys and k != "default" else "unknown-key", None, None))
            yield pd.DataFrame({"hmac_state": [o[0] for o in out], "generation": pd.array([o[1] for o in out], dtype="Int64"), "key_ids": pd.Series([o[2] for o in out], dtype=object)})

    return parsed.withColumn("_h", state("signed", "hmac", "key_id")).select(*parsed.columns, "_h.*")


#: The kinds of the entry from which on a lane is signed, and of the one that retires a key.
KEY_INTRODUCED, KEY_ROTATED = "audit-key-introduced", "audit-key-rotate"


def line_trust(lines: DataFrame, keys: dict[str, str], retired: dict[str, int] | None = None) -> DataFrame:
    """lane, line_no, trust.

    chain-broken from the lane's first bad line on; a line that a held key refutes is one, and so
    is one under a retired key behind a line of a newer generation of keys, or behind an
    authenticated entry that retires that key. A reader without keys finds the rest
    self-consistent. With keys: authenticated with a verified HMAC, but not-authenticated under
    a retired key if no line of a newer generation follows, as nothing shows that it was
    written before; under a key not held, rewrite-not-excluded behind a verified line, else
    other-key. Unkeyed lines before the lane's first keyed one are pre-key if that one
    introduces the key and is authenticated, other-key if it introduces a key not held; all
    other unkeyed lines are not-authenticated, as their HMAC may have been taken off. The
    newest generation so far is a prefix scan over ranges of lines.
    """
    n, s, generation = F.col("line_no"), F.col("hmac_state"), F.col("generation")
    field = lambda f: F.get_json_object("raw", f"$.{f}")
    p = check_hmac(parse_lines(lines), keys, retired)
    p = p.select("lane", "line_no", "hmac_state", "generation", "key_ids", field("kind").alias("_kind"), field("from").alias("_from"))
    chain = verify_chain(lines).select(F.col("lane").alias("_lane"), F.col("first_bad").alias("_bad"))
    if not keys:
        j = p.join(chain, F.col("lane") == F.col("_lane"))
        return j.select("lane", "line_no", F.when(n >= F.col("_bad"), "chain-broken").otherwise("self-consistent").alias("trust"))

    p = written(running(p, ["lane"], "line_no", "generation", "_newest", "max"))
    aged = (s == "verified") & (generation < IN_USE)
    marks = p.filter((s == "verified") & F.col("_kind").eqNullSafe(KEY_ROTATED) & F.col("_from").isNotNull()).groupBy(F.col("lane").alias("_ml"), F.col("_from").alias("_key")).agg(F.min("line_no").alias("_marked"))
    named = p.filter(aged).select("lane", "line_no", "generation", "_newest", F.explode("key_ids").alias("_id")).join(marks, (F.col("lane") == F.col("_ml")) & (F.col("_id") == F.col("_key")), "left")
    refused = named.filter((F.col("_newest") > generation) | (n > F.col("_marked"))).groupBy(F.col("lane").alias("_rl")).agg(F.min("line_no").alias("_refused"))

    first = F.struct(n.alias("n"), s.alias("s"), F.col("_kind").eqNullSafe(KEY_INTRODUCED).alias("intro"), generation.alias("generation"))
    firsts = p.groupBy(F.col("lane").alias("_of")).agg(F.min(F.when(s == "verified", n)).alias("first_auth"), F.min(F.when(s == "mismatch", n)).alias("_refuted"), F.min(F.when(s != "none", first)).alias("keyed"))
    lanes = firsts.join(chain, F.col("_of") == F.col("_lane")).join(refused, F.col("_of") == F.col("_rl"), "left").select("_of", "first_auth", "keyed", F.least("_bad", "_refuted", "_refused").alias("first_bad"))
    tops = p.join(lanes.select("_of", "first_bad"), F.col("lane") == F.col("_of")).filter(F.col("first_bad").isNull() | (n < F.col("first_bad"))).groupBy(F.col("lane").alias("_tl")).agg(F.max("generation").alias("_top"))
    j = p.join(lanes, F.col("lane") == F.col("_of")).join(tops, F.col("lane") == F.col("_tl"), "left")
    unproven = lambda g: (g < IN_USE) & (g >= F.col("_top"))
    keyed = F.col("keyed")
    before = (n < keyed["n"]) & keyed["intro"] & (F.col("first_bad").isNull() | (keyed["n"] < F.col("first_bad")))
    trust = (
        F.when(n >= F.col("first_bad"), "chain-broken")
        .when((s == "verified") & unproven(generation), "not-authenticated")
        .when(s == "verified", "authenticated")
        .when((s == "unknown-key") & (n > F.col("first_auth")), "rewrite-not-excluded")
        .when(s == "unknown-key", "other-key")
        .when(before & (keyed["s"] == "verified") & ~unproven(keyed["generation"]), "pre-key")
        .when(before & (keyed["s"] == "unknown-key"), "other-key")
        .otherwise("not-authenticated")
    )
    return j.select("lane", "line_no", trust.alias("trust"))


USABLE = ("authenticated", "self-consistent", "pre-key")


def trust_counts(trust: DataFrame) -> DataFrame:
    return trust.groupBy("lane", "trust").agg(F.count("*").alias("n"))


def check_anchors(heads: DataFrame, lines: DataFrame, anchors: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """lane, state: of recorded anchors (lane, entries, head) against lanes now.

    missing; truncated (fewer lines); rewritten (another hash at the anchored line, or a chain
    broken up to it); not-authenticated (broken behind it, or with `trust` a line up to it that
    is not usable); else intact, as is any anchor of no entries.
    """
    at = parse_lines(lines).select(F.col("lane").alias("_lane"), F.col("line_no").alias("_line"), F.col("entry").alias("_entry"))
    h = heads.select(F.col("lane").alias("_hl"), F.col("entries").alias("_n"), F.col("first_bad").alias("_bad"))
    j = anchors.join(h, F.col("lane") == F.col("_hl"), "left").join(at, (F.col("lane") == F.col("_lane")) & (F.col("entries") == F.col("_line")), "left")
    if trust is None:
        j = j.withColumn("_unusable", F.lit(None).cast("long"))
    else:
        j = j.join(trust.filter(~F.col("trust").isin(*USABLE)).groupBy(F.col("lane").alias("_tl")).agg(F.min("line_no").alias("_unusable")), F.col("lane") == F.col("_tl"), "left")
    n = F.col("entries")
    state = (
        F.when(F.col("_hl").isNull(), "missing")
        .when(n == 0, "intact")
        .when(F.col("_n") < n, "truncated")
        .when(~F.col("_entry").eqNullSafe(F.col("head")) | F.coalesce(F.col("_bad") <= n, F.lit(False)), "rewritten")
        .when(F.col("_bad").isNotNull() | (F.col("_unusable") <= n), "not-authenticated")
        .otherwise("intact")
    )
    return j.select("lane", state.alias("state"))


def advance_anchors(heads: DataFrame, trust: DataFrame, anchors: DataFrame) -> DataFrame:
    """lane, entries, head, integrity: the anchors to record after a check.

    A lane whose lines are all usable gets an anchor at its end (authenticated if all of them
    are, else self-consistent); any other keeps the one it had (anchor-kept). If any lane fails
    (broken, fewer lines than anchored, another head at the same length, or gone), no anchor
    moves and all come back as they were (unchanged).
    """
    good = trust.groupBy("lane").agg(F.bool_and(F.col("trust").isin(*USABLE)).alias("_pass"), F.bool_and(F.col("trust") == "authenticated").alias("_auth"))
    was = anchors.select(F.col("lane").alias("_al"), F.col("entries").alias("_was"), F.col("head").alias("_old"))
    j = heads.join(good, "lane", "left").join(was, F.col("lane") == F.col("_al"), "full_outer")
    failed = F.col("lane").isNull() | (F.col("status") != "intact") | (F.col("entries") < F.col("_was")) | ((F.col("entries") == F.col("_was")) & ~F.col("head").eqNullSafe(F.col("_old")))
    j = j.crossJoin(F.broadcast(j.agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("_failed"))))
    new = ~F.col("_failed") & F.coalesce("_pass", F.lit(False))
    integrity = F.when(F.col("_failed"), "unchanged").when(~new, "anchor-kept").when(F.col("_auth"), "authenticated").otherwise("self-consistent")
    out = j.filter(new | F.col("_al").isNotNull())
    return out.select(F.coalesce("lane", "_al").alias("lane"), F.when(new, F.col("entries")).otherwise(F.col("_was")).alias("entries"), F.when(new, F.col("head")).otherwise(F.col("_old")).alias("head"), integrity.alias("integrity"))


#: Lanes whose entries are about their output only, and lanes without records.
OUTPUT_LANES = ("artifacts/clips/export-log.jsonl", "artifacts/proxies/proxy-log.jsonl", "artifacts/thumbnails/thumbnail-log.jsonl")
KEYLESS_LANES = ("evidence/logs/signoff-log.jsonl", "evidence/logs/e01-audit.jsonl")
RECORD_FIELDS = ("id", "record_id", "selector", "target_path", "output_path")


def recency_keys(lane: Column, body: Column) -> Column:
    """What a log entry (JSON text) is about: an array of field=value keys."""
    text = lambda f: F.nullif(F.get_json_object(body, f"$.{f}"), F.lit(""))
    key = lambda f: F.concat(F.lit(f"{f}="), text(f))
    event = text("event")
    inode = F.when(event == "recover-inode", F.concat(F.lit("inode="), F.coalesce(text("partition_offset"), F.lit("0")), F.lit(":"), text("inode")))
    run = F.when((lane == "evidence/logs/hash-verify.jsonl") & event.isin("hash-verify", "hash-verify-run"), key("run_id"))
    about = F.array_compact(F.array(*[key(f) for f in RECORD_FIELDS], inode, run))
    summary = F.when((F.size(about) == 0) & (event == "transcode-queue"), F.array(F.lit("event=transcode-queue"))).otherwise(about)
    own = lane.isin(*OUTPUT_LANES) | ((lane == "artifacts/logs/transcode-queue-log.jsonl") & F.coalesce(event == "transcode-queue-item", F.lit(False)))
    none = F.array().cast("array<string>")
    return F.when(lane.isin(*KEYLESS_LANES), none).when(own, F.array_compact(F.array(key("output_path")))).otherwise(summary)


def current_entries(entries: DataFrame) -> DataFrame:
    """lane, key, line_no, usable, superseded: the last entry of each key (entries: lane, key, line_no, usable); superseded tells that an unusable last entry hides a usable one."""
    g = entries.groupBy("lane", "key").agg(F.max("line_no").alias("line_no"), F.max_by("usable", "line_no").alias("usable"), F.max(F.when(F.col("usable"), F.col("line_no"))).alias("_last_usable"))
    return g.select("lane", "key", "line_no", "usable", (~F.col("usable") & F.col("_last_usable").isNotNull()).alias("superseded"))


RANKS = {"unverified": 0, "self-consistent": 1, "authenticated": 2}


def measurement_latest(measurements: DataFrame) -> DataFrame:
    """selector, lane, line_no, trust, value of the measurement that counts.

    A selector's measurements are gone through in order of time, lane and line. The later one
    counts unless it is trusted less than the one before; but an unverified line of the same
    lane replaces any, so that a record is never rolled back to an older measurement. Lines at
    or before the lane's last repair are unverified.
    """
    repair = measurements.filter("is_repair").groupBy("lane").agg(F.max("line_no").alias("_repair"))
    m = measurements.filter("not is_repair").join(repair, "lane", "left")
    m = m.withColumn("trust", F.when(F.col("line_no") <= F.col("_repair"), "unverified").otherwise(F.col("trust")))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("trust"))
    entry = F.struct("ts", "lane", "line_no", rank.alias("rank"), "trust", "value")
    lines = m.groupBy("selector").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    stays = lambda old, new: (old["rank"] > new["rank"]) & ~((old["lane"] == new["lane"]) & (new["rank"] == 0))
    last = F.reduce("es", F.col("es")[0], lambda old, new: F.when(stays(old, new), old).otherwise(new))
    return lines.select("selector", last.alias("b")).select("selector", "b.lane", "b.line_no", "b.trust", "b.value")


CLOCK_MARGIN_SECONDS = 600


def run_result(entries: DataFrame, now: int) -> DataFrame:
    """One row per lane: run_id whose completion marker is last, withheld, reasons, clock_anomaly.

    entries: lane, line_no, run_id, is_marker, usable, is_repair, ts. The result is withheld
    if an unfinished run began later, another completed run's lines overlap its own, an
    unusable line follows the marker, or a repair does.
    """
    runs = entries.filter("run_id is not null").groupBy("lane", "run_id").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.max(F.when(F.col("is_marker") & F.col("usable"), F.col("line_no"))).alias("marker"), F.max("ts").alias("ts"))
    won = runs.filter("marker is not null").groupBy("lane").agg(F.max_by(F.struct("run_id", "lo", "hi", "marker", "ts"), "marker").alias("w"))
    others = runs.join(won, "lane").filter(F.col("run_id") != F.col("w.run_id"))
    o = others.groupBy("lane").agg(
        F.bool_or(F.col("marker").isNull() & (F.col("hi") > F.col("w.hi"))).alias("unfinished"),
        F.bool_or(F.col("marker").isNotNull() & (F.col("lo") <= F.col("w.hi")) & (F.col("hi") >= F.col("w.lo"))).alias("overlap"),
    )
    after = entries.join(won, "lane").filter(F.col("line_no") > F.col("w.marker")).groupBy("lane").agg(F.bool_or(~F.col("usable")).alias("unusable_after"), F.bool_or("is_repair").alias("repair_after"))
    j = won.join(o, "lane", "left").join(after, "lane", "left")
    names = {"unfinished": "newer-unfinished-run", "overlap": "overlapping-run", "unusable_after": "unusable-after-marker", "repair_after": "repair-after-marker"}
    reasons = F.array_compact(F.array(*[F.when(F.col(c), n) for c, n in names.items()]))
    return j.select("lane", F.col("w.run_id").alias("run_id"), (F.size(reasons) > 0).alias("withheld"), reasons.alias("reasons"), (F.col("w.ts") > now + CLOCK_MARGIN_SECONDS).alias("clock_anomaly"))


def pair_lifecycle(entries: DataFrame) -> DataFrame:
    """id, state: open, completed, resolved or unpaired, from begin, complete and resolve events (id, event, lane, line_no) in line order. Of a lane's begins without an end, only the latest can be open."""
    at = lambda e: F.max(F.when(F.col("event") == e, F.col("line_no")))
    g = entries.groupBy("lane", "id").agg(at("begin").alias("b"), at("complete").alias("c"), at("resolve").alias("r"))
    latest = Window.partitionBy("lane")
    g = g.withColumn("_last", F.max("b").over(latest))
    ended = F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("r", F.lit(0)))
    state = F.when(F.col("b").isNull(), "unpaired").when(ended > F.col("b"), F.when(F.coalesce("r", F.lit(0)) > F.coalesce("c", F.lit(0)), "resolved").otherwise("completed")).when(F.col("b") == F.col("_last"), "open").otherwise("unpaired")
    return g.select("lane", "id", state.alias("state"))
