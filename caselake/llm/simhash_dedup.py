"""Near-duplicate documents by SimHash fingerprints, joined on keys from the Golay code.

A document's fingerprint has 64 bits, set by majority over the XXH64 values of its 3-word
shingles. Two fingerprints link if they differ in 3 bits or fewer, and documents fall into
classes along links.

*Candidates.* The fingerprint is cut into segments A (23 bits), B (23) and C (18, filled up
to 23 with zeros). The perfect binary Golay code puts every 23-bit word within 3 bits of
exactly one codeword. A segment's *near codewords* are those of the word itself and of all
words that differ from it in one bit: one codeword if the word lies within 2 bits of it,
else six. Two words that differ in 2 bits or fewer have a word between them, and so share a
near codeword. Three errors over three segments leave these cases, each with its own key:

* a segment is equal, and the next one (A to B, B to C, C to A) has 2 errors at most: the
  equal segment with a near codeword of the next. This holds for every way to put up to 3
  errors on fewer than three segments, since one that holds 3 leaves the other two equal;
* each segment has one error: one half of each is equal, eight choices of halves.

So any two fingerprints within 3 bits share one of about 24 keys; all that share a key are
compared exactly. Rows of a very frequent key are dealt into chunks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, split_hot, unused

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
SEGMENTS = (("A", 0, 23), ("B", 23, 23), ("C", 46, 18))
RADIUS = 3
#: A key's rows beyond this number are dealt into chunks.
CHUNK = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer; 0 for null and for texts without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - width + 1)
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n], stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint of `text` as a long (the bits of the unsigned value)."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_signed([fingerprint(t) for t in texts]))

    return docs.withColumn(out, of(F.col(text)))


@lru_cache(1)
def _errors() -> np.ndarray:
    """By syndrome: the one word of at most 3 bits that has it. Made from the code's polynomial."""
    table = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            table[int(_syndrome(np.array([word]))[0])] = word
    return table


@lru_cache(1)
def _remainders() -> list[int]:
    """x^i modulo the generator polynomial, for each bit i."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words), dtype=np.int64)
    for bit, r in enumerate(_remainders()):
        total ^= ((words >> bit) & 1) * r
    return total


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _errors()[_syndrome(words)]) >> 11


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, codeword number): the distinct codewords of each word and of its neighbours at one bit."""
    all_ = np.stack([codeword_index(words), *(codeword_index(words ^ (1 << b)) for b in range(23))], axis=1)
    all_.sort(axis=1)
    new = np.ones(all_.shape, dtype=bool)
    new[:, 1:] = all_[:, 1:] != all_[:, :-1]
    row, col = np.nonzero(new)
    return row, all_[row, col]


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): for unsigned 64-bit fingerprints, the keys of which two within 3 bits share one."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for _, at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, code = near_codewords(seg[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 36) | (seg[i][row] << 12) | code)
    half = [(s & 0x1FF, s >> 9) if n == 18 else (s & 0xFFF, s >> 12) for s, (_, _, n) in zip(seg, SEGMENTS, strict=True)]
    for choice in range(8):
        a, b, c = (half[k][choice >> k & 1] for k in range(3))
        rows.append(np.arange(len(fps)))
        keys.append((np.int64(3 + choice) << 36) | (a << 24) | (b << 12) | c)
    return np.concatenate(rows), np.concatenate(keys)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent positions) of a spanning forest of the links among `fps`; work grows
    with the square of their number, memory in proportion to it."""
    left, child, parent = np.arange(len(fps)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            one, front = front[0], front[1:]
            near = np.bitwise_count(fps[left] ^ fps[one]) <= radius
            found = left[near]
            if len(found):
                child.append(found)
                parent.append(np.full(len(found), one))
                front, left = np.concatenate([front, found]), left[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def _links_of_run(run: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links among rows of equal (key, lo, hi), which stand together in `run`."""
    fps, node = run["fp"].to_numpy().view(np.uint64), run["node"].to_numpy()
    same = np.ones(len(run), dtype=bool)
    for c in ("key", "lo", "hi"):
        v = run[c].to_numpy()
        same[1:] &= v[1:] == v[:-1]
    same[0] = False
    first = np.flatnonzero(~same)
    sizes = np.diff(np.append(first, len(run)))
    a, b = [], []
    small, head = np.repeat(sizes <= 16, sizes), np.repeat(first, sizes)
    pairs = []
    for off in range(1, 16):
        here = np.flatnonzero(small[off:] & (head[off:] == head[:-off]))
        if not len(here):
            break
        here = here[np.bitwise_count(fps[here] ^ fps[here + off]) <= radius]
        pairs.append(np.stack([here, here + off]))
    if pairs:
        i, j = np.concatenate(pairs, axis=1)
        # Where all of a run link, links to its first row are enough.
        links = np.bincount(head[i], minlength=len(run))
        keep = (i == head[i]) | (links[head[i]] < (np.repeat(sizes * (sizes - 1) // 2, sizes))[i])
        a.append(node[j[keep]])
        b.append(node[i[keep]])
    for at, n in zip(first[sizes > 16], sizes[sizes > 16], strict=True):
        child, parent = forest(fps[at : at + n], radius)
        a.append(node[at : at + n][child])
        b.append(node[at : at + n][parent])
    return pd.DataFrame({"a": np.concatenate(a) if a else node[:0], "b": np.concatenate(b) if b else node[:0]}).drop_duplicates()


def link_runs(batches: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """Over rows sorted by (key, lo, hi): the links within each run of equal ones."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        open_ = (batch["key"] == last["key"]) & (batch["lo"] == last["lo"]) & (batch["hi"] == last["hi"])
        if open_.all() and held and tuple(held[-1].iloc[-1][["key", "lo", "hi"]]) == tuple(last[["key", "lo", "hi"]]):
            held.append(batch)
            continue
        run = pd.concat([*held, batch[~open_]]) if held else batch[~open_]
        held = [batch[open_]]
        if len(run):
            yield _links_of_run(run, radius)
    if held:
        yield _links_of_run(pd.concat(held), radius)


def link_keyed(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the nodes (key, fp, node) that share a key and differ in `radius` bits of fp at most."""
    dealt = split_hot(keys, "key", "node", CHUNK)
    # Sorted by node too, so that runs link their rows to the same few small ones.
    met = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return components(met.select("key", "lo", "hi", "fp", "node").mapInPandas(lambda batches: link_runs(batches, radius), "a long, b long"))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Class of each distinct fingerprint: (node, component), for those that link with another.

    `fps` has fp (long, distinct) and node (long). The component is its smallest node.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.iloc[at : at + 8192]
                row, key = join_keys(part["fp"].to_numpy().view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": part["fp"].to_numpy()[row], "node": part["node"].to_numpy()[row]})

    return link_keyed(fps.mapInPandas(keyed, "key long, fp long, node long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest id that links reach from the document, its own included.
    kept is true for the first row of each class (that of the smallest id). A null text and
    one without words have fingerprint zero and link as any other. Rows without an id get a
    fingerprint and the class of equal or near rows that have one, else null; they are kept
    only if no row of their class has an id. Rows that repeat an id count as one document.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    fps = cut(fingerprints(slim, "_text", "fp").select("_id", "fp"))
    nodes = cut(fps.filter("_id is not null").groupBy("fp").agg(F.min("_id").alias("node")))
    classes = link_fingerprints(nodes)
    where = nodes.join(classes, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    out = fps.join(cut(where), F.col("fp") == F.col("_fp"), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        (F.col("_id") == F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """`docs` with one document of each class that `classes` finds: that of the smallest id.

    Of rows that repeat the id of one that stays, one stays. Rows without an id all stay.
    """
    slim = docs.select(id_col, text_col)
    marks = classes(slim, id_col, text_col).filter(F.col(id_col).isNotNull())
    key = unused(docs, "_id")
    counts = cut(marks.groupBy(F.col(id_col).alias(key)).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")))
    gone = counts.filter("not kept or rows > 1").select(key)
    stay = docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
    again = counts.filter("kept and rows > 1").select(key)
    if again.isEmpty():
        return stay
    return stay.unionByName(docs.join(again, F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col]))
