"""Near-duplicate documents by the weighted similarity of their 5-word shingles, tested exactly.

A document is the multiset of its shingles; two documents link if the shingles that they
share number 0.8 or more of those that either has, repeats counted, and documents fall into
classes along links.

*Candidates* come from SimHash and the Golay code, as in `simhash_dedup`, with a longer
fingerprint. Its bits are majorities over pairs of words, as a changed word changes five
shingles but two pairs. A key is the head of a segment of 23 bits with a near codeword of the
next segment, so two documents share one if some head is equal and the segment behind it has
2 errors or fewer: fewer errors than segments can't spoil them all, and of the pairs just
above 0.8, whose bits differ one in ten, about one in a thousand shares no key. Those that
share a key and differ in at most 14 of 64 further bits are neighbours, and the components of
neighbours are what the test looks at. With more documents heads get longer, so that keys
stay rare, and segments more, so that as many pairs share one (`layout`).

*Test.* The k-th occurrence of a shingle is an element of its own, so documents become sets
with the same similarity. The sets of a component meet, each shipped once; a large component
is dealt into chunks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, cut, split_hot
from .simhash_dedup import link_keyed, near_codewords

WIDTH = 5
BITS = 23
#: Neighbours differ in so many of 64 further bits at most.
RADIUS = 14
#: A component's rows beyond this number are dealt into chunks.
CHUNK = 1024
_DRAW = np.random.default_rng(42).integers(0, 1 << 63, (64, 2), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * _GOLDEN
    return values ^ (values >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 42) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)


def layout(documents: int) -> tuple[int, int]:
    """(bits of a head, segments). A pair that differs in one bit of ten shares a key of a given segment at odds of 0.75 * 0.9^head."""
    head = min(BITS, max(8, int(documents).bit_length() - 10))
    return head, int(np.ceil(6.5 / (0.75 * 0.9**head)))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words; of all, if they are fewer."""
    n = max(1, len(words) - width + 1)
    values = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        values = values * _DRAW[0, 0] + words[k : k + n]
    return _mixed(values)


def elements(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit elements of the shingles of hashed words, one for each occurrence; fewer words are one shingle, none have none."""
    if not len(words):
        return words
    values = shingles(words, width)
    values.sort()
    n = len(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    if len(first) < n:
        again = (np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))).astype(np.uint64)
        values ^= again * _GOLDEN
        values.sort()
    return values


def fingerprint(words: np.ndarray, segments: int) -> tuple[np.ndarray, int]:
    """(segments of 23 bits, 64 further bits): majorities over hashed pairs of words, repeats counted."""
    pairs = shingles(words, 2)
    longs = -(-segments * BITS // 64) + 1
    ones = np.zeros(64 * longs, dtype=np.int64)
    for at in range(0, len(pairs), 255):  # sums of 255 bits fit a byte
        drawn = np.stack([_mixed(pairs[at : at + 255] * a + b) for a, b in _DRAW[:longs]], axis=1)
        ones += np.add.reduce(np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    bits = 2 * ones > len(pairs)
    parts = bits[: segments * BITS].reshape(segments, BITS) @ (1 << np.arange(BITS))
    return parts, int(np.packbits(bits[-64:], bitorder="little").view("<i8")[0])


def wide_keys(segments: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for rows of segments: each segment's head with each near codeword of the next one."""
    rows, keys = [], []
    for k in range(segments.shape[1]):
        row, code = near_codewords(segments[:, (k + 1) % segments.shape[1]])
        rows.append(row)
        keys.append((np.int64(k) << 35) | ((segments[row, k] & ((1 << head) - 1)) << 12) | code)
    return np.concatenate(rows), np.concatenate(keys)


def _name(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def similar_forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent positions) of a spanning forest of the pairs of similarity 0.8 or more."""
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(len(words), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    left, child, parent = np.arange(len(sets)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        at = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in left]) if len(left) else left
        own = flat[at]
        while front and len(left):
            one = front.pop()
            mine = flat[starts[one] : starts[one] + sizes[one]]
            has[mine] = 1
            n = sizes[left]
            both = np.add.reduceat(has[own], np.cumsum(n) - n)
            has[mine] = 0
            near = 9 * both >= 4 * (n + sizes[one])  # both / (n + size - both) >= 4 / 5
            if near.any():
                found = left[near]
                child.append(found)
                parent.append(np.full(len(found), one))
                front += found.tolist()
                own, left = own[np.repeat(~near, n)], left[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def _link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by (key, lo, hi): the links within each run of equal ones."""

    def links(rows: list[tuple]) -> pd.DataFrame:
        child, parent = similar_forest([np.frombuffer(r[1], dtype=np.uint64) for r in rows])
        node = np.array([r[0] for r in rows], dtype=np.int64)
        return pd.DataFrame({"a": node[child], "b": node[parent]})

    run, held = None, []
    for batch in batches:
        for key, lo, hi, node, values in zip(*(batch[c] for c in ("key", "lo", "hi", "node", "values")), strict=True):
            if (key, lo, hi) != run:
                if len(held) > 1:
                    yield links(held)
                run, held = (key, lo, hi), []
            held.append((node, bytes(values)))
    if len(held) > 1:
        yield links(held)


def similar_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, component_id, kept; the rules of `simhash_dedup.near_duplicates`.

    Texts without words, null ones included, are one class.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    head, segments = layout(docs.count())

    @F.pandas_udf("same binary, segments array<int>, further long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = word_hashes(t)
                rows.append((_name(elements(words)), *(fingerprint(words, segments) if len(words) else (None, 0))))
            yield pd.DataFrame(rows, columns=["same", "segments", "further"])

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                row, key = wide_keys(np.stack(part["segments"].to_numpy()).astype(np.int64), head)
                yield pd.DataFrame({"key": key, "fp": part["further"].to_numpy()[row], "node": part["node"].to_numpy()[row]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [elements(word_hashes(t)) for t in batch["_text"]]
            yield pd.DataFrame({"_same": [_name(s) for s in sets], "values": [s.tobytes() for s in sets]})

    marked = cut(slim.select("_id", signed("_text").alias("_s")).select("_id", "_s.same", "_s.segments", "_s.further"))
    nodes = marked.filter("_id is not null").groupBy("same").agg(F.min("_id").alias("node"), F.min(F.struct("segments", "further")).alias("s"))
    nodes = cut(nodes.select("same", "node", "s.segments", "s.further"))
    keys = nodes.filter("segments is not null").mapInPandas(keyed, "key long, fp long, node long")
    neighbours = link_keyed(keys, RADIUS).withColumnRenamed("component", "key").withColumnRenamed("node", "_node")
    members = cut(nodes.select("same", "node").join(neighbours, F.col("node") == F.col("_node")).select("key", "same", "node"))
    ids = members.select(F.col("node").alias("_node"))
    few = members.count() <= BROADCAST_ROWS
    texts = slim.join(F.broadcast(ids) if few else ids, F.col("_id") == F.col("_node"), "left_semi")
    sets = texts.mapInPandas(whole, "_same binary, values binary").dropDuplicates(["_same"])
    dealt = split_hot(members, "key", "node", CHUNK).join(sets, F.col("same") == F.col("_same"))
    dealt = dealt.select("key", "lo", "hi", "node", "values").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    classes = components(dealt.mapInPandas(_link_runs, "a long, b long"))
    where = nodes.join(classes, "node", "left").select(F.col("same").alias("_same"), F.coalesce("component", "node").alias("component_id"))
    out = marked.select("_id", "same").join(where, F.col("same") == F.col("_same"), "left")
    return out.select(F.col("_id").alias(id_col), "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
