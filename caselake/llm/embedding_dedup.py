"""Near-duplicate vectors by cosine, with a pigeonhole join over rotated subspaces.

Vectors of length 1 whose cosine is c or more lie within squared distance 2 - 2c. A fixed
random rotation spreads that distance evenly over the coordinates, which are cut into blocks
of 16 dimensions. Each block has a budget in proportion to its dimensions, and two vectors
within the whole distance keep the budget in at least one block.

Each block is joined by range: space is cut into cells along the block's first dimensions,
each at least twice as wide as the budget's radius; a vector lives in its own cell and
visits those that its ball touches and that come later. Two vectors within the budget meet
exactly once in that block. A pair counts in the first block where it keeps the budget, so
the union of all candidates is counted once, after its cosine is computed in double
precision. Large cells are dealt into chunks that meet pairwise. Pairs are never written:
each cell gives its vectors' numbers of links, and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, split_hot

LEAST = 0.95
BLOCK_DIMS = 16
#: A cell's rows beyond this number are dealt into chunks.
CHUNK = 16384
#: Room for rounding in the candidate search; the cosine itself has none.
SLACK = 1e-6
#: More room for the first, single-precision look at a block's distances.
ROUNDING = 1e-5


def grid_dims(rows: int) -> int:
    """Dimensions of a block's grid: two, and one more for each 2.5 times the rows that two leave too full, up to eight.

    Each one parts cells in two or three, and lets a vector visit twice as many.
    """
    return int(np.clip(2 + np.ceil(np.log(max(1, rows) / (8 * CHUNK)) / np.log(2.5)), 2, 8))


class Subspaces:
    """The rotation, the blocks and their budgets, for vectors of `dims` dimensions."""

    def __init__(self, dims: int, least: float = LEAST, block_dims: int = BLOCK_DIMS, grid: int = 2):
        q, r = np.linalg.qr(np.random.default_rng(42).standard_normal((dims, dims)))
        self.rotation = q * np.sign(np.diag(r))
        self.edges = [*range(0, dims, block_dims), dims]
        total = 2 - 2 * least
        self.budgets = [total * (b - a) / dims + SLACK for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.grid_dims = grid

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x @ self.rotation

    def cells(self, y: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell number, home) for rotated vectors: each one's own cell, and the later ones that its ball touches."""
        a = self.edges[block]
        g = min(self.grid_dims, self.edges[block + 1] - a)
        radius = np.sqrt(self.budgets[block])
        width = 2 * radius
        z = y[:, a : a + g]
        span = int(np.ceil(1 / width)) + 2
        code = lambda c: (c + span) @ np.array([(2 * span + 1) ** k for k in range(g)], dtype=np.int64)
        own = np.floor(z / width).astype(np.int64)
        low, high = np.floor((z - radius) / width).astype(np.int64), np.floor((z + radius) / width).astype(np.int64)
        home = code(own)
        rows, cells, homes = [np.arange(len(y))], [home], [np.ones(len(y), dtype=bool)]
        for choice in product((0, 1), repeat=g):
            corner = np.where(np.array(choice, dtype=bool), high, low)
            fresh = np.ones(len(y), dtype=bool)
            for k in range(g):
                fresh &= ~((corner[:, k] == low[:, k]) & bool(choice[k]))
            there = code(corner)
            ok = fresh & (there > home)
            rows.append(np.flatnonzero(ok))
            cells.append(there[ok])
            homes.append(np.zeros(int(ok.sum()), dtype=bool))
        return np.concatenate(rows), np.concatenate(cells) * len(self.budgets) + block, np.concatenate(homes)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length 1, safe from overflow."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_cell(x: np.ndarray, times: np.ndarray, home: np.ndarray, side: np.ndarray, across: bool, block: int, space: Subspaces, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, and a spanning forest's edges) among the rows of one cell.

    Pairs of two visitors meet elsewhere. `across`: only pairs of different `side` count. The
    rows are sorted along the block's last dimension, and each meets those within the radius there.
    """
    y = space.rotated(x)
    band = y[:, space.edges[block + 1] - 1]
    order = np.argsort(band, kind="stable")
    x, y, times, home, side, band = x[order], y[order], times[order], home[order], side[order], band[order]
    reach = np.sqrt(space.budgets[block] + ROUNDING)
    part = slice(space.edges[block], space.edges[block + 1])
    links, root, a_out, b_out = np.zeros(len(x), dtype=np.int64), list(range(len(x))), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    yb = y[:, part]
    norm, one = (yb**2).sum(axis=1, keepdims=True), np.ones((len(x), 1))
    left = np.hstack([-2 * yb, norm, one]).astype(np.float32)
    right = np.hstack([yb, one, norm]).astype(np.float32).T.copy()
    within = np.float32(space.budgets[block] + ROUNDING)
    homes = np.flatnonzero(home)
    for at in range(0, len(homes), 256):
        h = homes[at : at + 256]
        lo, hi = np.searchsorted(band, band[h[0]] - reach), np.searchsorted(band, band[h[-1]] + reach, side="right")
        i, j = np.divmod(np.flatnonzero(left[h] @ right[:, lo:hi] <= within), hi - lo)
        i, j = h[i], j + lo
        meet = (~home[j] | (j > i)) & (side[i] != side[j] if across else True)
        i, j = i[meet], j[meet]
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= least
            p, q = p[ok], q[ok]
            first = ((y[p, part] - y[q, part]) ** 2).sum(axis=1) <= space.budgets[block]
            for b in range(block):
                s = slice(space.edges[b], space.edges[b + 1])
                first &= ((y[p, s] - y[q, s]) ** 2).sum(axis=1) > space.budgets[b]
            p, q = p[first], q[first]
            np.add.at(links, p, times[q])
            np.add.at(links, q, times[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                ru, rv = find(u), find(v)
                if ru != rv:
                    root[max(ru, rv)] = min(ru, rv)
                    a_out.append(u)
                    b_out.append(v)
    counted = np.zeros_like(links)
    counted[order] = links
    return counted, order[np.array(a_out, dtype=np.int64)], order[np.array(b_out, dtype=np.int64)]


def valid(vector: str):
    """True for vectors with components, all finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cells_of(space: Subspaces):
    """A vectorised function of the cells that a vector lives in or visits, over all blocks."""

    @F.pandas_udf("array<struct<cell:long,home:boolean>>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(batch))]
            if len(batch):
                y = space.rotated(unit(np.stack(batch.to_numpy())))
                for block in range(len(space.budgets)):
                    for r, c, h in zip(*(v.tolist() for v in space.cells(y, block)), strict=True):
                        out[r].append({"cell": c, "home": h})
            yield pd.Series(out)

    return cells


def linker(space: Subspaces, least: float):
    """What a cell's rows give: rows with links, and rows with edges."""

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        x = unit(np.stack(group["v"].to_numpy()))
        block = int(group["cell"].iat[0] % len(space.budgets))
        across = bool(group["lo"].iat[0] != group["hi"].iat[0])
        links, a, b = link_cell(x, group["times"].to_numpy(), group["home"].to_numpy(dtype=bool), group["_chunk"].to_numpy(), across, block, space, least)
        rep = group["rep"].to_numpy()
        some = np.flatnonzero(links)
        return pd.DataFrame({
            "rep": np.concatenate([rep[some], rep[a]]),
            "links": np.concatenate([links[some], np.zeros(len(a), dtype=np.int64)]),
            "other": pd.array(np.concatenate([np.full(len(some), -1), rep[b]]), dtype="Int64"),
            "edge": np.concatenate([np.zeros(len(some), dtype=bool), np.ones(len(a), dtype=bool)]),
        })

    return linked


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors link if their cosine is `least` or more; rows that repeat a vector link with
    each other. n_links counts the other rows that a row links with, component_id is the
    smallest id that links reach from it, its own included, and kept tells whether that is
    its own. Vectors that are null, zero, empty, or hold null or non-finite components link with
    nothing, nor do rows without an id; vectors of different dimensions are never linked.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("v"))
    fit = rows.filter(valid("v") & F.col("_id").isNotNull())
    reps = cut(fit.groupBy("v").agg(F.min("_id").alias("rep"), F.count("*").alias("times")))
    # One job for each length that two vectors or more have: others link with nothing. Lengths are few where a model made the vectors.
    dims = sorted((r["dims"], r["rows"]) for r in reps.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("rows")).filter("rows > 1").collect())

    found = None
    for n, rows_of in dims:
        space = Subspaces(n, least, grid=grid_dims(rows_of))

        placed = cut(reps.filter(F.size("v") == n).withColumn("cells", cells_of(space)("v")))
        spread = placed.withColumn("at", F.explode("cells")).select("rep", "times", "v", "at.cell", "at.home")
        dealt = split_hot(spread, "cell", "rep", CHUNK, keep_chunk=True)
        part = dealt.groupBy("cell", "lo", "hi").applyInPandas(linker(space, least), "rep long, links long, other long, edge boolean")
        found = part if found is None else found.unionByName(part)

    if found is None:
        found = vectors.sparkSession.createDataFrame([], "rep long, links long, other long, edge boolean")
    found = cut(found)
    links = found.filter("not edge").groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.filter("edge").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = reps.join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    known = cut(known.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    fits = F.when(valid("v") & F.col("_id").isNotNull(), F.col("v"))
    out = rows.withColumn("v", fits).join(known, F.col("v") == F.col("_v"), "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
