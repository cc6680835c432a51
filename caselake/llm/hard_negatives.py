"""Hard negatives of anchors: candidate blocks along a Hilbert curve, chosen by zone maps.

Vectors of integers are put in the order of a Hilbert curve through all their dimensions and
written as Parquet in blocks of that order. A block's zone map holds the least and greatest
value of each dimension; interval arithmetic on it bounds the inner product of an anchor with
any row of the block from both sides. An anchor first reads its own block. What it finds there
sets a floor under its best positives, later under the best rows of each window, and only
blocks whose bounds reach above the floor (and not wholly beyond the window) are read further.
Bounds are exact integers, so nothing is lost, however poorly they prune.

Anchors are dealt in chunks of neighbours. The zones tell which blocks a chunk must read, one
row per chunk and block; a task takes one chunk with those of one group of blocks, goes through
these block by block, tests each anchor's bounds again and raises its floor as it finds. So a
task holds a chunk and a group, whatever the number of anchors and rows, even where bounds prune
nothing. No anchors, zones or vectors go to the driver or to all executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows of a block; blocks of a group, about; a chunk has as many anchors as this many blocks would have, were every EVERYth row one; zones that are looked at together, about.
BLOCK_ROWS, GROUP_BLOCKS, CHUNK_BLOCKS, ZONES = 1024, 16, 512, 4096
#: Bits of each dimension in the Hilbert key.
KEY_BITS = 4
#: Rows whose id this divides are anchors; how many positives an anchor has, and negatives each of its windows.
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Scores of a slice of anchors with a block, at once.
SLICE = 256
#: Spark's ids of rows have the row's place in its partition in so many bits; blocks and groups have their place there in so many.
RANGE_BITS, PLACE_BITS = 33, 24
#: Below and above every score.
LEAST, MOST = -(2**63), 2**63 - 1


def hilbert_keys(coordinates: np.ndarray, bits: int = KEY_BITS) -> list[bytes]:
    """Places along a Hilbert curve, as bytes in order, of rows of coordinates below 2 ** bits.

    After Skilling, Programming the Hilbert curve (2004): undo the excess work from the highest
    bit down, take the Gray code over the dimensions, and interleave the bits.
    """
    x = coordinates.astype(np.int64).T.copy()
    dims, n = x.shape
    if not dims:
        return [b""] * n
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * dims, n)
    return [row.tobytes() for row in np.packbits(planes.T.astype(np.uint8), axis=1)]


def hilbert_key(vector: Column) -> Column:
    """The key of a vector of integers: each is first squeezed into 0 to 2 ** KEY_BITS by its arc tangent, about a unit vector's size."""

    @F.pandas_udf("binary")
    def key(vectors: pd.Series) -> pd.Series:
        out = pd.Series([b""] * len(vectors), index=vectors.index, dtype=object)
        for _, same in vectors.groupby(vectors.map(len)):
            v = np.stack(same.to_numpy()).astype(np.float64)
            near = 0.5 + np.arctan(v / 256 * np.sqrt(max(1, v.shape[1]))) / np.pi
            out[same.index] = hilbert_keys(np.clip((near * (1 << KEY_BITS)).astype(np.int64), 0, (1 << KEY_BITS) - 1))
        return out

    return key(vector)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while those are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each row of `a` with any vector between `lo` and `hi`, row by row of these."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _rows(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if dims else np.zeros((len(column), 0), dtype=np.int64)


def _objects(values: list) -> pd.Series:
    """A column of lists, each a value of its own even if all are equally long."""
    out = np.empty(len(values), dtype=object)
    for k, v in enumerate(values):
        out[k] = list(v)
    return pd.Series(out, dtype=object)


ZONE = "block long, dims int, low array<long>, high array<long>, labels array<int>"


def _zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Zones of each batch's blocks; a block that lies in two batches has a zone for either part."""
    for batch in batches:
        out: list[tuple] = []
        for (block, dims), rows in batch.groupby(["block", "dims"]):
            v = _rows(rows["v"], dims)
            out.append((block, dims, v.min(axis=0), v.max(axis=0), np.unique(rows["label"])))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pd.DataFrame({n: _objects(c) if n in ("low", "high", "labels") else c for n, c in zip((c.split()[0] for c in ZONE.split(", ")), columns, strict=True)})


def _windows(anchors: pd.DataFrame) -> np.ndarray:
    """lo, hi and floor of each anchor's windows, by anchor and window; where an anchor has fewer, windows that hold nothing."""
    out = np.empty((3, len(anchors), max(map(len, anchors["lo"]), default=0)), dtype=np.int64)
    out[0], out[1], out[2] = MOST, LEAST, MOST
    for of, name in zip(out, ("lo", "hi", "floor"), strict=True):
        for row, x in zip(of, anchors[name], strict=True):
            row[: len(x)] = x
    return out


def _reach(least: np.ndarray, most: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which bounds (by anchor and zone) leave room for a score in one of the anchor's windows, at its floor or above."""
    need = np.zeros(least.shape, dtype=bool)
    for lo, hi, floor in windows.transpose(2, 0, 1)[:, :, :, None]:
        need |= (least <= hi) & (np.minimum(most, hi) >= np.maximum(lo, floor))
    return need


def _labelled(labels: np.ndarray, theirs: list[np.ndarray], same: bool) -> np.ndarray:
    """By label and zone: has the zone rows of this label, or of another one, if not `same`."""
    mine, at = np.unique(labels, return_inverse=True)
    has = np.zeros((len(mine), len(theirs)), dtype=bool)
    for k, x in enumerate(theirs):
        has[:, k] = np.isin(mine, x) if same else (len(x) > 1) | (mine != x[0])
    return has[at]


WANTED = "dims int, chunk long, block long"


def _chosen(same: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Which of some zones' blocks some anchors of a chunk must read."""

    def choose(anchors: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(zones):
            return pd.DataFrame({"dims": [], "chunk": [], "block": []})
        dims, block = int(zones["dims"].iat[0]), zones["block"].to_numpy()
        low, high, has = _rows(zones["low"], dims), _rows(zones["high"], dims), [np.asarray(x) for x in zones["labels"]]
        wanted = np.zeros(len(block), dtype=bool)
        for at in range(0, len(anchors), SLICE):
            part, rest = anchors.iloc[at : at + SLICE], np.flatnonzero(~wanted)
            if not len(rest):
                break
            need = _reach(*bounds(_rows(part["a"], dims), low[rest], high[rest]), _windows(part)) & (part["home"].to_numpy()[:, None] != block[rest])
            wanted[rest] = (need & _labelled(part["label"].to_numpy(), [has[k] for k in rest], same)).any(axis=0)
        return pd.DataFrame({"dims": dims, "chunk": int(anchors["chunk"].iat[0]), "block": np.unique(block[wanted])})

    return choose


FOUND = "rid long, lo long, hi long, pos long, id long, score long"


class _Best:
    """The first `most` rows of each anchor's windows by score down, id and place, among those put in."""

    def __init__(self, windows: np.ndarray, most: int) -> None:
        self.windows, self.most = windows, most
        # Of the last of `most` rows; while there are fewer, any id may stand at the floor.
        self.last = np.full(windows.shape[1:], MOST)
        self.score, self.id, self.pos = (np.full((*windows.shape[1:], most), -1) for _ in range(3))

    def put(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> None:
        for w in range(self.windows.shape[2]):
            lo, hi, floor = self.windows[:, who, w]
            can = (score >= lo) & (score <= hi) & ((score > floor) | (score == floor) & (ids <= self.last[who, w]))
            if not can.any():
                continue
            again = np.unique(who[can])
            old = [x[again, w].ravel() for x in (self.score, self.id, self.pos)]
            k = np.concatenate([who[can], np.repeat(again, self.most)])
            s, i, p = (np.concatenate([x[can], y]) for x, y in zip((score, ids, pos), old, strict=True))
            k, s, i, p = (x[p >= 0] for x in (k, s, i, p))
            order = np.lexsort((p, i, ~s, k))
            rank = np.arange(len(k)) - np.searchsorted(k[order], k[order])
            order, rank = order[rank < self.most], rank[rank < self.most]
            for held, x in ((self.score, s), (self.id, i), (self.pos, p)):
                held[k[order], w, rank] = x[order]
            full = again[self.pos[again, w, -1] >= 0]
            self.windows[2, full, w] = self.score[full, w, -1]
            self.last[full, w] = self.id[full, w, -1]

    def found(self, rid: np.ndarray) -> pd.DataFrame:
        who, w, n = np.nonzero(self.pos >= 0)
        return pd.DataFrame({"rid": rid[who], "lo": self.windows[0, who, w], "hi": self.windows[1, who, w], "pos": self.pos[who, w, n], "id": self.id[who, w, n], "score": self.score[who, w, n]})


def _exact(a: np.ndarray, v: np.ndarray) -> tuple[type, int]:
    """The narrowest type in which inner products of integer rows are exact, and a bound of them."""
    most = max(1, a.shape[1])
    for x in (a, v):
        most *= max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return (np.float32 if most < 2**24 - 1 else np.float64 if most < 2**53 - 1 else np.int64), most


def _best(same: bool, own: bool, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The best rows in some anchors' windows among the blocks of a group: only their own blocks, or only others within reach."""

    def answer(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        dims = int(rows["_dims"].iat[0])
        a, rid, home, label = _rows(asked["a"], dims), *(asked[c].to_numpy() for c in ("rid", "home", "label"))
        best = _Best(_windows(asked), most)
        block = rows["block_"].to_numpy()
        order = np.argsort(block, kind="stable")
        v, block, ids, pos, labels = _rows(rows["v_"], dims)[order], block[order], *(rows[c].to_numpy()[order] for c in ("id_", "pos_", "label_"))
        kind, top = _exact(a, v)
        left, right = a.astype(kind), v.astype(kind)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        spans = [slice(x, y) for x, y in zip(starts, [*starts[1:], len(block)], strict=True)]
        if not own:
            least, greatest = bounds(a, np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)) if dims else np.zeros((2, len(a), len(starts)), dtype=np.int64)
            fits = _labelled(label, [np.unique(labels[x]) for x in spans], same)
        for n, span in enumerate(spans):
            here = home == block[span.start]
            who = np.flatnonzero(here if own else ~here & fits[:, n] & _reach(least[:, n : n + 1], greatest[:, n : n + 1], best.windows)[:, 0])
            for at in range(0, len(who), SLICE):
                part = who[at : at + SLICE]
                scores = left[part] @ right[span].T
                lo, hi, floor = best.windows[:, part]
                lo, hi = np.maximum(lo, floor).min(axis=1), hi.max(axis=1)
                if kind is not np.int64:
                    lo, hi = (np.clip(x, -top - 1, top + 1).astype(kind) for x in (lo, hi))
                # Most rows stand below the floors: what else counts is looked at for the others only.
                high = np.flatnonzero(scores >= lo[:, None])
                i, j = np.divmod(high, scores.shape[1])
                s = scores.ravel()[high]
                can = (s <= hi[i]) & ((labels[span][j] == label[part][i]) == same)
                if same:
                    can &= pos[span][j] != rid[part][i]
                if can.any():
                    i, j = i[can], j[can]
                    best.put(part[i], s[can].astype(np.int64), ids[span][j], pos[span][j])
        return best.found(rid)

    return answer


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dims, v: the rows that take part, with components floor(256 * x); where 7 divides the id, the label is the next one of ten."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)).cast("int")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.size(x).alias("dims"), whole.alias("v"))


def _group(block: str) -> Column:
    """The group of a block: its partition's, and a further one for each so many blocks that are too many for one."""
    place = F.expr(f"{block} & {(1 << PLACE_BITS) - 1}")
    return F.shiftleft(F.shiftright(block, PLACE_BITS), PLACE_BITS) + F.floor(place / (2 * GROUP_BLOCKS))


def _rows_of(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("dims").alias("_dims"), F.col("block").alias("block_"), *[F.col(c).alias(n) for c, n in (("pos", "pos_"), ("vec_id", "id_"), ("label", "label_"), ("v", "v_"))])


def _own(anchors: DataFrame, placed: DataFrame, same: bool, most: int) -> DataFrame:
    """What anchors find in their own blocks."""
    asked, rows = anchors.withColumn("group", _group("home")), _rows_of(placed).withColumn("_group", _group("block_"))
    return asked.groupBy("dims", "group").cogroup(rows.groupBy("_dims", "_group")).applyInPandas(_best(same, True, most), FOUND)


def _far(anchors: DataFrame, placed: DataFrame, zones: DataFrame, same: bool, most: int) -> DataFrame:
    """What anchors find in other blocks: chunks of anchors meet zones, then the groups of the blocks that they must read."""
    part = F.floor(F.shiftright("block", PLACE_BITS) / max(1, ZONES // GROUP_BLOCKS))
    each = lambda df, c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(df.agg(F.max(c)).first()[0] or 0).cast("long")))
    a = anchors.withColumn("part", each(zones, part))
    z = zones.withColumns({"part": part, "chunk": each(anchors, "chunk")})
    keys = ["dims", "chunk", "part"]
    wanted = cut(a.groupBy(*keys).cogroup(z.groupBy(*keys)).applyInPandas(_chosen(same), WANTED))
    asked = anchors.join(wanted.select("dims", "chunk", _group("block").alias("group")).distinct(), ["dims", "chunk"])
    blocks = wanted.select(F.col("dims").alias("_d"), F.col("chunk").alias("_chunk"), F.col("block").alias("_b"))
    rows = _rows_of(placed).join(blocks, (F.col("_dims") == F.col("_d")) & (F.col("block_") == F.col("_b"))).drop("_d", "_b").withColumn("_group", _group("block_"))
    return asked.groupBy("dims", "chunk", "group").cogroup(rows.groupBy("_dims", "_chunk", "_group")).applyInPandas(_best(same, False, most), FOUND)


def _in_chunks(anchors: DataFrame) -> DataFrame:
    """Add `chunk`: anchors are counted along the curve. A global window runs over one row per block only."""
    along = Window.orderBy("dims", "home").rowsBetween(Window.unboundedPreceding, -1)
    before = anchors.groupBy("dims", "home").count().select("dims", "home", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("dims", "home").orderBy("rid")) - 1
    return anchors.join(before, ["dims", "home"]).withColumn("chunk", F.floor(place / max(1, CHUNK_BLOCKS * BLOCK_ROWS // EVERY))).drop("_before")


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without an id or label, or with a vector that is null or holds a null or non-finite
    component, take no part. A score is the integer inner product with the anchor; rows of
    other dimensions have none. Higher scores come first, ties by the smaller id. An anchor (an
    id that 50 divides) has its first 5 other rows of its label as positives; each gives the
    first 3 rows of other labels with a score from 50 to 95 hundredths of the positive's. Rows that
    repeat an id are rows of their own. Products must fit 64 bits. No anchors, no rows.
    """
    rows = cut(quantised(vectors, id_col, vector_col, label_col).withColumn("key", hilbert_key(F.col("v"))))
    groups = max(1, -(-rows.count() // (BLOCK_ROWS * GROUP_BLOCKS)))
    ranged = rows.repartitionByRange(groups, "dims", "key", "vec_id").sortWithinPartitions("dims", "key", "vec_id")
    block = F.shiftleft(F.shiftright("pos", RANGE_BITS), PLACE_BITS) + F.floor(F.expr(f"pos & {(1 << RANGE_BITS) - 1}") / BLOCK_ROWS)
    placed = cut(ranged.withColumn("pos", F.monotonically_increasing_id()).drop("key")).withColumn("block", block)
    zones = cut(placed.select("block", "dims", "label", "v").mapInPandas(_zones, ZONE))
    anchors = placed.filter(F.col("vec_id") % EVERY == 0).select(F.col("pos").alias("rid"), F.col("block").alias("home"), "dims", F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("a"))
    anchors = cut(_in_chunks(anchors))

    any_ = {"lo": F.array(F.lit(LEAST)), "hi": F.array(F.lit(MOST))}
    near = cut(_own(anchors.withColumns(any_ | {"floor": any_["lo"]}), placed, True, POSITIVES))
    floors = near.groupBy("rid").agg(F.when(F.count("*") == POSITIVES, F.min("score")).alias("_least"))
    floored = cut(anchors.join(floors, "rid", "left").withColumns(any_ | {"floor": F.array(F.coalesce("_least", F.lit(LEAST)))}).drop("_least"))
    found = near.unionByName(_far(floored, placed, zones, True, POSITIVES))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "id", "pos")
    first = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= POSITIVES)
    positives = cut(first.select("rid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr("(score + 1) div 2").alias("lo"), F.expr("95 * score div 100").alias("hi"), "_n"))

    spans = positives.filter("positive_score >= 0 and lo <= hi").select("rid", "lo", "hi").distinct()
    windows = lambda floor: F.array_sort(F.collect_list(F.struct("lo", "hi", floor.alias("floor"))))
    part = lambda c: F.transform("w", lambda x: x[c])
    aimed = lambda df, floor: cut(anchors.join(df.groupBy("rid").agg(windows(floor).alias("w")).select("rid", *[part(c).alias(c) for c in ("lo", "hi", "floor")]), "rid"))
    near = cut(_own(aimed(spans, F.col("lo")), placed, False, NEGATIVES))
    least = near.groupBy("rid", "lo", "hi").agg(F.when(F.count("*") == NEGATIVES, F.min("score")).alias("_least"))
    found = near.unionByName(_far(aimed(spans.join(least, ["rid", "lo", "hi"], "left"), F.coalesce("_least", "lo")), placed, zones, False, NEGATIVES))
    order = Window.partitionBy("rid", "lo", "hi").orderBy(F.desc("score"), "id", "pos")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    ranked = ranked.select("rid", "lo", "hi", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(ranked, ["rid", "lo", "hi"]).join(anchors.select("rid", "anchor_id"), "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
