"""SentencePiece encoding and decoding by vectorised merge rounds.

A model of kind BPE with byte fallback joins, again and again, the two neighbours whose
concatenation is the best piece, the leftmost first. Two neighbouring characters that stand
side by side in no piece are never joined, so the text falls into words there, each of
which is merged by itself. All new words of a batch of texts are merged together, in flat NumPy
arrays (a bounded number is remembered): every round finds the best pair of each word (a segmented minimum), joins all its
occurrences from left to right, and drops words in which no pair is left.

Joining all occurrences at once equals one by one unless the new piece can at once be joined
to something as good or better; for such pieces (the model tells them) a round joins the
leftmost only. Words that need very many rounds (a megabyte of blanks) go through a heap.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the model lies on every machine; a parameter of each function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the sign that stands for a blank in pieces.
BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters looked at together, about: a task holds some sixty bytes for each.
SPAN = 1 << 18
#: Words of up to so many characters are remembered, so many at a time, before a task starts anew.
MEMORABLE, REMEMBERED = 32, 1 << 18
#: Characters whose neighbours are not in the small table.
ASK = 2
#: After so many rounds, words of more symbols than `LONG` leave the rounds for a heap.
ROUNDS, LONG = 48, 256
GONE = np.iinfo(np.int32).min
NEVER = np.iinfo(np.int32).max


def _one_byte_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("caselake.one_byte_each", _one_byte_each)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        if size is None:
            size = varint()
        yield tag >> 3, message[at : at + size]
        at += size


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of `wanted` in the sorted `keys`; -1 where it is none of them."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], -1)


def _gather(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs data[offset : offset + size], one after the other."""
    ends = np.cumsum(sizes)
    if not len(sizes) or not ends[-1]:
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(offsets - (ends - sizes), sizes)]


class PieceModel:
    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(_fields(b"".join(v for k, v in parts if k == 2)))
        normal = dict(_fields(b"".join(v for k, v in parts if k == 3)))
        # Fields of the format: kind 3, blanks as suffix 24, byte fallback 35; table 2, blank in front 3, blanks squeezed 4, blanks escaped 5.
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not trainer.get(35, 0) or normal.get(2, b"") or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only BPE models with byte fallback and plain normalisation are supported")
        rows = [dict(_fields(v)) for k, v in parts if k == 1]
        self.pieces = [r[1].decode() for r in rows]
        self.kinds = np.array([r.get(3, NORMAL) for r in rows])
        if set(self.kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        scores = np.array([struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows])
        self._tables(scores)
        surface = trainer.get(44, " ⁇ ".encode())
        spelled = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), UNKNOWN: lambda p: surface, CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        as_bytes = [spelled[k](p) for p, k in zip(self.pieces, self.kinds.tolist(), strict=True)]
        self._bytes = np.frombuffer(b"".join(as_bytes), dtype=np.uint8)
        self._sizes = np.array([len(b) for b in as_bytes], dtype=np.int64)
        self._offsets = np.cumsum(self._sizes) - self._sizes
        self._byte_ids = np.zeros(256, dtype=np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self._byte_ids[int(self.pieces[i][3:5], 16)] = i

    def _tables(self, scores: np.ndarray) -> None:
        of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds.tolist(), strict=True)) if k == NORMAL}
        inside = sorted({c for p in of for c in p} - set(of))
        symbols = of | {c: len(self.pieces) + k for k, c in enumerate(inside)}
        self._inside = np.array([ord(c) for c in inside], dtype=np.int64)
        self._width = len(self.pieces) + len(inside)
        self._char = np.full(0x110000, -1, dtype=np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self._char[ord(c)] = s
        ranks = np.unique(-scores, return_inverse=True)[1]
        self._rank = np.append(np.append(ranks, np.full(len(inside), NEVER)), NEVER).astype(np.int32)  # the last is that of no pair, -1
        pairs = {symbols[p[:k]] * self._width + symbols[p[k:]]: i for p, i in of.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self._pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self._pair_piece = np.array([pairs[k] for k in self._pair_keys.tolist()], dtype=np.int32)
        self._pair_of = pairs
        self._hasty = np.zeros(self._width, dtype=bool)
        for side in (self._pair_keys // self._width, self._pair_keys % self._width):
            self._hasty[side[self._rank[self._pair_piece] <= self._rank[side]]] = True
        neighbours = {(ord(a) << 21) | ord(b): of.get(a + b, -1) for p in of for a, b in zip(p, p[1:], strict=False)}
        self._neighbours = np.array(sorted(neighbours), dtype=np.int64)
        self._neighbour_piece = np.array([neighbours[k] for k in self._neighbours.tolist()], dtype=np.int32)
        self._known: dict[str, bytes] = {}
        # ASCII characters and the blank sign have places of their own in a small table of neighbours; 0 is any other.
        near = [*range(1, 128), ord(BLANK)]
        self._small = np.zeros(0x110000, dtype=np.uint8)
        self._small[near] = np.arange(1, len(near) + 1)
        self._joined = np.full((len(near) + 1, len(near) + 1), ASK, dtype=np.uint8)
        self._joined[1:, 1:] = [[((a << 21) | b) in neighbours for b in near] for a in near]

    def _begins(self, chars: np.ndarray) -> np.ndarray:
        """Where in `chars` a word begins, the first one left aside: no piece holds a character behind the one before it."""
        close = self._small[chars]
        joined = self._joined[close[:-1], close[1:]]
        odd = np.flatnonzero(joined == ASK)
        joined[odd] = _find(self._neighbours, (chars[odd].astype(np.int64) << 21) | chars[odd + 1], np.arange(len(self._neighbours))) >= 0
        return joined == 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids); an empty text has none."""
        full = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        text = "".join(full)
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in full], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        new = np.zeros(len(chars) + 1, dtype=bool)
        new[begins] = True
        counts = np.zeros(len(texts), dtype=np.int64)
        at, ids = 0, []
        while at < len(chars):
            to, look = at + SPAN, 4096
            found = None
            while to < len(chars) and found is None:  # a span ends where a word begins
                end = min(to + look, len(chars))
                starts = new[to:end] | self._begins(chars[to - 1 : end])
                found = to + int(np.argmax(starts)) if starts.any() else None
                to, look = (to + look if found is None else found), 2 * look
            to = min(to, len(chars))
            first = new[at:to].copy()
            first[0] = True
            first[1:] |= self._begins(chars[at:to])
            starts = np.flatnonzero(first) + at
            edges = starts.tolist()
            got = self._words([text[a:b] for a, b in zip(edges, [*edges[1:], to], strict=True)])
            doc = int(np.searchsorted(begins, at, side="right")) - 1
            end = int(np.searchsorted(begins, to))
            cuts = [0, *np.searchsorted(starts, begins[doc + 1 : end]).tolist(), len(got)]
            for d, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), doc):
                ids.append(b"".join(got[a:b]))
                counts[d] += len(ids[-1]) // 4
            at = to
        return np.frombuffer(b"".join(ids), dtype=np.int32), counts

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words, as bytes. Words met before are remembered, up to a bound; all others are merged together."""
        found = list(map(self._known.get, words))
        missing = list({w: None for w, f in zip(words, found, strict=True) if f is None})
        if missing:
            sizes = np.array([len(w) for w in missing], dtype=np.int64)
            begins = np.cumsum(sizes) - sizes
            chars = np.frombuffer("".join(missing).encode("utf-32-le"), dtype=np.uint32)
            new = np.zeros(len(chars), dtype=bool)
            new[begins] = True
            flat, place = self._span(chars, new)
            data, edges = flat.astype(np.int32).tobytes(), (np.searchsorted(place, np.append(begins, len(chars))) * 4).tolist()
            fresh = {w: data[a:b] for w, a, b in zip(missing, edges, edges[1:], strict=False)}
            found = [fresh[w] if f is None else f for w, f in zip(words, found, strict=True)]
            if len(self._known) + len(fresh) > REMEMBERED:
                self._known.clear()
            self._known.update((w, b) for w, b in fresh.items() if len(w) <= MEMORABLE)
        return found

    def _span(self, chars: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place of the character where each begins) of whole words."""
        known = self._char[chars]
        out = np.where(known < 0, -1 - chars.astype(np.int32), known)
        key = (chars[:-1].astype(np.int64) << 21) | chars[1:]
        at = _find(self._neighbours, key, np.arange(len(self._neighbours)))
        first = np.ones(len(chars), dtype=bool)
        first[1:] = (at < 0) | new[1:]
        pair = np.full(len(chars), -1, dtype=np.int32)
        pair[:-1] = np.where(first[1:], -1, self._neighbour_piece[at])
        self._rounds(out, first, pair)
        place = np.flatnonzero(out != GONE)
        return self._spelled(out[place], place)

    def _rounds(self, out: np.ndarray, first: np.ndarray, pair: np.ndarray) -> None:
        """Merge in place: out holds each symbol where it begins, `GONE` elsewhere; first marks words' beginnings, pair the piece that a symbol makes with the next one."""
        slot, sym, done = np.arange(len(out)), out, 0
        while len(slot):
            starts = np.flatnonzero(first)
            rank = self._rank[pair]
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(slot)))
            if done >= ROUNDS:
                for w in np.flatnonzero((best < NEVER) & (sizes > LONG)):
                    part = slice(starts[w], starts[w] + sizes[w])
                    out[slot[part]] = self._one_by_one(sym[part])
                    best[w] = NEVER
            live = best < NEVER
            if not live.all():
                stay = np.repeat(live, sizes)
                slot, sym, first, pair, rank = slot[stay], sym[stay], first[stay], pair[stay], rank[stay]
                best, sizes = best[live], sizes[live]
                if not len(slot):
                    return
            word = np.repeat(np.arange(len(best)), sizes)
            can = np.flatnonzero(rank == best[word])
            k = np.arange(len(can))
            run = np.maximum.accumulate(np.where(np.append(True, can[1:] != can[:-1] + 1), k, 0))
            take = can[(k - run) % 2 == 0]
            hasty = self._hasty[pair[take]]
            if hasty.any():
                w = word[take]
                only = np.zeros(len(best), dtype=bool)
                only[w[hasty]] = True
                take = take[np.append(True, w[1:] != w[:-1]) | ~only[w]]
            sym = sym.copy() if sym is out else sym
            sym[take] = pair[take]
            out[slot[take]], out[slot[take + 1]] = sym[take], GONE
            stay = np.ones(len(slot), dtype=bool)
            stay[take + 1] = False
            slot, sym, first, pair = slot[stay], sym[stay], first[stay], pair[stay]
            now = take - np.arange(len(take))
            fresh = np.concatenate([now, now[~first[now]] - 1])
            pair[fresh] = -1
            fresh = fresh[fresh + 1 < len(slot)]
            fresh = fresh[~first[fresh + 1]]
            pair[fresh] = _find(self._pair_keys, sym[fresh].astype(np.int64) * self._width + sym[fresh + 1], self._pair_piece)
            done += 1

    def _one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one word with a heap of its pairs: symbols where they begin, `GONE` elsewhere."""
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self._rank
        made = [self._pair_of.get(a * self._width + b, -1) for a, b in zip(sym, sym[1:], strict=False)] + [-1]
        heap = [(int(rank[m]) << 40) | i for i, m in enumerate(made) if m >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & ((1 << 40) - 1)
            if made[i] < 0 or int(rank[made[i]]) != top >> 40:
                continue
            j = after[i]
            sym[i], sym[j], made[j] = made[i], GONE, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    made[k] = self._pair_of.get(sym[k] * self._width + sym[after[k]], -1) if after[k] < n else -1
                    if made[k] >= 0:
                        heapq.heappush(heap, (int(rank[made[k]]) << 40) | k)
        return np.array(sym, dtype=np.int32)

    def _spelled(self, sym: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places): characters without a piece become the ids of their bytes."""
        code = np.where(sym < 0, -1 - sym, -1).astype(np.int64)
        if len(self._inside):
            code = np.where(sym >= len(self.pieces), self._inside[np.maximum(sym - len(self.pieces), 0) % len(self._inside)], code)
        plain = code < 0
        if plain.all():
            return sym, place
        odd = np.frombuffer("".join(map(chr, code[~plain].tolist())).encode(), dtype=np.uint8)
        sizes = np.where(plain, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        ids = np.repeat(sym, sizes)
        ids[np.repeat(~plain, sizes)] = self._byte_ids[odd]
        return ids, np.repeat(place, sizes)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other. Bytes that are no UTF-8 become U+FFFD one by one; an id outside the model raises IndexError."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise IndexError("an id is outside the model")
        data = _gather(self._bytes, self._offsets[ids], self._sizes[ids])
        ends = np.append(0, np.cumsum(self._sizes[ids]))
        shown = np.append(np.flatnonzero(self.kinds[ids] != CONTROL), len(ids))
        to = np.cumsum(counts)
        out = []
        marks = np.flatnonzero(self.kinds[ids] == CONTROL)
        for a, b in zip((to - counts).tolist(), to.tolist(), strict=True):
            inner = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b)].tolist()  # bytes on both sides of a control id make no character
            text = "".join(data[ends[x] : ends[y]].tobytes().decode("utf-8", "caselake.one_byte_each") for x, y in zip([a, *inner], [*inner, b], strict=True))
            head = int(shown[np.searchsorted(shown, a)])
            blank = head < b and self.kinds[ids[head]] == NORMAL and self.pieces[ids[head]].startswith(BLANK)
            out.append(text[1:] if blank else text)
        return out


@lru_cache(2)
def model(path: str = MODEL) -> PieceModel:
    return PieceModel(path)


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows that hold about `SPAN` characters or ids each; a larger row stands alone."""
    at = held = 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > SPAN:
            yield slice(at, k)
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def encoded(text: Column, path: str = MODEL) -> Column:
    """The ids of a text, array<int>; null is taken as empty."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        for batch in batches:
            texts = [t or "" for t in batch]
            out: list[np.ndarray] = []
            for part in _portions(np.array([len(t) for t in texts], dtype=np.int64)):
                flat, counts = own.encode(texts[part])
                out += np.split(flat, np.cumsum(counts)[:-1])
            yield pd.Series(out, dtype=object)

    return ids(text)


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of ids; null stays null, and a null among the ids is an error."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        for batch in batches:
            rows = [np.zeros(0, dtype=np.int64) if r is None else np.asarray(r) for r in batch]
            if any(r.dtype.kind == "f" for r in rows):
                raise ValueError("an id is null")
            counts = np.array([len(r) for r in rows], dtype=np.int64)
            out: list[str | None] = []
            for part in _portions(counts):
                out += own.decode(np.concatenate(rows[part]), counts[part])
            yield pd.Series([None if r is None else t for r, t in zip(batch, out, strict=True)], dtype=object)

    return text(ids)


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """`docs` with the ids of each whole text, array<int>, in a new column `ids_col`.

    No begin or end ids. A null or empty text has no ids; rows that repeat are encoded each;
    a column of that name is refused.
    """
    if ids_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {ids_col}")
    return docs.withColumn(ids_col, encoded(F.col(text_col), path))


def decode_documents(tokens: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """`tokens` with the text of each row's ids in a new column `text_col`; null ids give null, no ids an empty text."""
    if text_col.lower() in {c.lower() for c in tokens.columns}:
        raise ValueError(f"the rows have a column {text_col}")
    return tokens.withColumn(text_col, decoded(F.col(ids_col), path))


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """id, ids, decoded: each document's ids and what they decode to, in one pass of one worker, which holds a span's ids and texts at a time. A null text is taken as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
            for part in _portions(sizes):
                n = part.stop - part.start
                flat, counts = own.encode([t or "" for t in text.slice(part.start, n).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([key.slice(part.start, n), ids, pa.array(own.decode(flat, counts), pa.string())], ["id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(both, f"id {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 (of what the ids decode to)."""
    both = round_trips(docs, id_col, text_col, path)
    return both.select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
