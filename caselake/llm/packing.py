"""Packing tokenised documents into rows of fixed length, best fit first by decreasing length.

A task encodes its documents, cuts those longer than a row into full rows and a rest, and
fills rows block by block: pieces go by decreasing length into the fullest row that still
has room, found by a segment tree over the capacities. No document crosses the network, and
a task holds one block of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, encoder

#: Tokens that a task gathers before it packs them.
BLOCK = 1_000_000


class Capacities:
    """Open rows by remaining capacity; finds the least capacity of at least n in log steps."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.used = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at:
            self.used[at] += 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with room for n; it leaves the tree."""
        at, used = n + self.leaves, self.used
        while not used[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if used[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            used[at] -= 1
            at >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of positions in `lengths`, each summing to `length` at most."""
    rows: list[list[int]] = []
    open_ = Capacities(length)
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        found = open_.take(n)
        if found is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(at)
        if capacity > n:
            open_.add(capacity - n, row)
    return rows


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, schema: pa.Schema) -> pa.RecordBatch:
    sizes = np.array([len(ids) for _, _, ids in pieces])
    rows = best_fit_decreasing(sizes, length)
    ids = np.full((len(rows), length), pad, dtype=np.int32)
    positions = np.zeros((len(rows), length), dtype=np.int32)
    order = [at for row in rows for at in row]
    ends: list[int] = []
    for k, row in enumerate(rows):
        at = 0
        ends.append(0)
        for piece in row:
            n = len(pieces[piece][2])
            ids[k, at : at + n] = pieces[piece][2]
            positions[k, at : at + n] = np.arange(n)
            at += n
            ends.append(at)
    per_row = np.array([len(r) for r in rows])
    flat = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length)
    by_piece = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
    by_end = pa.array(np.concatenate([[0], np.cumsum(per_row + 1)]).astype(np.int32))
    arrays = [
        pa.ListArray.from_arrays(flat, pa.array(ids.ravel())),
        pa.ListArray.from_arrays(by_end, pa.array(np.array(ends, dtype=np.int32))),
        pa.ListArray.from_arrays(flat, pa.array(positions.ravel())),
        pa.ListArray.from_arrays(by_piece, pa.array([pieces[at][0] for at in order], type=pa.int64())),
        pa.ListArray.from_arrays(by_piece, pa.array([pieces[at][1] for at in order], type=pa.int32())),
    ]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, length: int = 2048, end_token: bool = True, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of `length` token ids.

    input_ids: the ids, filled up with the end token's id. cu_seqlens: 0 and where each
    segment ends. position_ids: 0, 1, ... anew in each segment, and 0 in the filling.
    doc_ids, parts: for each segment its document, and which of the document's segments it
    is (from 0). Each document's tokens, with an end token behind them if `end_token`, lie in
    its segments in order, without loss or overlap. Null texts and texts without tokens take
    no place. Rows that repeat an id or a text are packed each by itself.
    """
    schema = pa.schema([(n, pa.list_(t)) for n, t in (("input_ids", pa.int32()), ("cu_seqlens", pa.int32()), ("position_ids", pa.int32()), ("doc_ids", pa.int64()), ("parts", pa.int32()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py())
                if not len(ids):
                    continue
                if end_token:
                    ids = np.append(ids, np.int32(enc.end))
                pieces += [(doc, k, ids[at : at + length]) for k, at in enumerate(range(0, len(ids), length))]
                held += len(ids)
                if held >= block:
                    yield _packed(pieces, length, enc.end, schema)
                    pieces, held = [], 0
        if pieces:
            yield _packed(pieces, length, enc.end, schema)

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return slim.mapInArrow(packed, "input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, parts array<int>")


def as_binary(packed: DataFrame, width: str = "<u2") -> DataFrame:
    """The same rows with input_ids and position_ids as little-endian bytes, for readers that map files; an id that `width` can't hold is an error."""
    most = np.iinfo(width).max

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in batch.schema.names:
                c = batch.column(name)
                if name in ("input_ids", "position_ids"):
                    rows = [np.asarray(v.values) for v in c]
                    if any(len(r) and r.max() > most for r in rows):
                        raise ValueError(f"{name} needs more than {width}")
                    c = pa.array([r.astype(width).tobytes() for r in rows], type=pa.binary())
                columns.append(c)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return packed.mapInArrow(to_bytes, "input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, parts array<int>")


def write_packed(docs: DataFrame, path: str, length: int = 2048, vocabulary: str = VOCABULARY) -> None:
    """Write the packed id matrix as Parquet rows of bytes (two for each id)."""
    as_binary(pack(docs, length, vocabulary=vocabulary)).write.mode("overwrite").parquet(path)
