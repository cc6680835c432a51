"""Running values along long sequences, and greedy chains, without one task per long sequence.

A sequence (the offsets of one image, the lines of one lane) may hold a third of all rows, so
no window runs along a long one whole. Positions are whole numbers. They are cut into ranges of fixed
width; each range is summed up to one row; the summaries are scanned in the same way, range of
ranges by range of ranges; and what a range brings in is joined to a window inside it. Ranges
come from arithmetic on positions, so a lost task finds the same ones again.

Sequences of `SHORT` rows at most, which a count by key tells, need none of that: all of them
pass through one window, or one walk over sorted rows, with a single shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Positions in a range are 2 ** RANGE_BITS; ranges in a range of ranges are 2 ** FAN_BITS, twice.
RANGE_BITS, FAN_BITS, LEVELS = 16, 10, 2
#: A sequence of more rows is cut into ranges.
SHORT = 500_000


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def _summary(how: str, value: str, order: list[str]) -> Column:
    if how == "max":
        return F.max(value)
    if how == "sum":
        return F.sum(value)
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def long_keys(df: DataFrame, keys: list[str], short: int | None = None) -> list[tuple]:
    """The keys with more than `short` rows (`SHORT` unless told), of which there is one for each `short` rows at most."""
    short = SHORT if short is None else short
    return [tuple(r) for r in df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > short).select(*keys).collect()]


def parted(df: DataFrame, keys: list[str], long: list[tuple]) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of short sequences and those of the `long` ones; None for a part that is known to be empty."""
    if not long:
        return df, None
    listed = df.sparkSession.createDataFrame(long, df.select(*[F.col(k).alias(f"_long{i}") for i, k in enumerate(keys)]).schema)
    on = _same(keys, [f"_long{i}" for i in range(len(keys))])
    return df.join(F.broadcast(listed), on, "left_anti"), df.join(F.broadcast(listed), on, "left_semi")


def running(df: DataFrame, keys: list[str], at: str, value: str, out: str, how: str, ties: tuple[str, ...] = (), inclusive: bool = False, bits: int = RANGE_BITS, levels: int = LEVELS, short: int | None = None, long: list[tuple] | None = None) -> DataFrame:
    """Add `out`: the max, sum or last non-null of `value` over the rows of the same keys before this one, in the order of `at` (a long), then `ties`; with `inclusive` this row counts too.

    Rows that agree in all of these must be interchangeable, and many at one position are one
    task: sum them up first. Null keys are keys; `at` is never null. Before the first row the
    value is null. `long`: the keys with more than `short` rows, where the caller has counted them.
    """
    few, many = parted(df, keys, long_keys(df, keys, short) if long is None else long)
    done = _in_window(few, keys, at, value, out, how, ties, inclusive)
    return done if many is None else done.unionByName(_in_ranges(many, keys, at, value, out, how, ties, inclusive, bits, levels))


def _in_window(df: DataFrame, keys: list[str], at: str, value: str, out: str, how: str, ties: tuple[str, ...], inclusive: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return df.withColumn(out, _over(how, value, w))


def _in_ranges(df: DataFrame, keys: list[str], at: str, value: str, out: str, how: str, ties: tuple[str, ...], inclusive: bool, bits: int, levels: int) -> DataFrame:
    if levels == 0:
        return _in_window(df, keys, at, value, out, how, ties, inclusive)
    names = [f"_key{levels}_{i}" for i in range(len(keys))]
    place, mine, total, brought, own = (f"_{n}{levels}" for n in ("place", "range", "total", "brought", "own"))
    df = df.withColumn(mine, F.shiftright(at, bits))
    sums = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(mine).alias(place)).agg(_summary(how, value, [at, *ties]).alias(total))
    carried = _in_ranges(sums, names, place, total, brought, how, (), False, FAN_BITS, levels - 1).drop(total)
    within = _in_window(df, [*keys, mine], at, value, own, how, ties, inclusive)
    both = within.join(carried, _same([*keys, mine], [*names, place]), "left")
    if how == "max":
        result = F.greatest(own, brought)
    elif how == "sum":
        result = F.when(F.col(own).isNotNull() | F.col(brought).isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(brought, F.lit(0)))
    else:
        result = F.coalesce(own, brought)
    return both.withColumn(out, result).drop(mine, own, brought, place, *names)


def _over(how: str, value: str, window) -> Column:
    return {"max": F.max(value), "sum": F.sum(value), "last": F.last(value, ignorenulls=True)}[how].over(window)


def following(df: DataFrame, keys: list[str], at: str, value: str, out: str, ties: tuple[str, ...] = (), bits: int = RANGE_BITS, short: int | None = None, long: list[tuple] | None = None) -> DataFrame:
    """Add `out`: the first non-null `value` over the rows of the same keys after this one."""
    back = [f"_b{i}" for i in range(len(ties))]
    turned = df.withColumns({"_at": -F.col(at), **{b: -F.col(t) for b, t in zip(back, ties, strict=True)}})
    return running(turned, keys, "_at", value, out, "last", tuple(back), bits=bits, short=short, long=long).drop("_at", *back)


def greedy_chain(steps: DataFrame, keys: list[str], at: str, until: str, bits: int = RANGE_BITS, short: int | None = None) -> DataFrame:
    """keys, `at`, `until` of the rows that a walk along each sequence keeps: the first row, then always the first one at or behind the kept one's `until`.

    steps: keys, `at` (unique in its sequence), `until` > `at`, all longs. Sequences of `short` rows at
    most are walked along sorted rows, many in a task; a walk holds one row.
    """
    long = long_keys(steps, keys, short)
    few, many = parted(steps.select(*keys, at, until), keys, long)
    walked = _walk(few, keys, at, until)
    return walked if many is None else walked.unionByName(_doubled(many, keys, at, until, bits, long))


def _walk(steps: DataFrame, keys: list[str], at: str, until: str) -> DataFrame:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, end = None, None
        for batch in batches:
            parts = [batch[k].astype(object).where(batch[k].notna(), None).tolist() for k in keys]
            keep = np.zeros(len(batch), dtype=bool)
            for n, (key, place, to) in enumerate(zip(zip(*parts, strict=True), batch[at].tolist(), batch[until].tolist(), strict=True)):
                if key != here or place >= end:
                    here, end, keep[n] = key, to, True
            yield batch[keep]

    return steps.repartition(*keys).sortWithinPartitions(*keys, at).mapInPandas(walk, steps.schema)


def _doubled(steps: DataFrame, keys: list[str], at: str, until: str, bits: int, long: list[tuple]) -> DataFrame:
    """The same for long sequences.

    Each row's successor is the first row at or behind its end, found by one scan over rows and
    ends. Reaching is doubled: the rows 2, 4, 8 ... steps on, until no chain is as long; then the
    kept rows grow from each sequence's first by those jumps from the longest down. So k doublings
    reach 2 ** k rows of every sequence at once, and no task walks along one.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = written(steps.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(at).alias("_at"), F.col(until).alias("_until")))
    none = F.lit(None).cast("long")
    marks = rows.select(*names, F.col("_at").alias("_p"), F.col("_at").alias("_row"), none.alias("_of"), F.lit(1).alias("_own")).unionByName(rows.select(*names, F.col("_until").alias("_p"), none.alias("_row"), F.col("_at").alias("_of"), F.lit(0).alias("_own")))
    # An end stands before a row at the same place, so that the row counts as behind it. Ends that meet at one place agree in what follows.
    ends = following(marks.groupBy(*names, "_p", "_own").agg(F.max("_row").alias("_row")), names, "_p", "_row", "_next", ("_own",), bits, long=long).filter("_own = 0 and _next is not null")
    ends = ends.select(*[F.col(n).alias(f"{n}e") for n in names], F.col("_p").alias("_end"), "_next")
    on = _same([*names, "_until"], [*[f"{n}e" for n in names], "_end"])
    jump = written(rows.join(ends, on).select(*names, F.col("_at").alias("_from"), F.col("_next").alias("_to")))
    jumps = []
    other = [f"{n}o" for n in names]
    while not jump.isEmpty():
        jumps.append(jump)
        second = jump.select(*[F.col(n).alias(o) for n, o in zip(names, other, strict=True)], F.col("_from").alias("_mid"), F.col("_to").alias("_far"))
        jump = written(jump.join(second, _same([*names, "_to"], [*other, "_mid"])).select(*names, "_from", F.col("_far").alias("_to")))
    kept = rows.groupBy(*names).agg(F.min("_at").alias("_at"))
    for jump in reversed(jumps):
        go = jump.select(*[F.col(n).alias(o) for n, o in zip(names, other, strict=True)], "_from", "_to")
        kept = written(kept.unionByName(kept.join(go, _same([*names, "_at"], [*other, "_from"])).select(*names, F.col("_to").alias("_at"))))
    back = kept.select(*[F.col(n).alias(o) for n, o in zip(names, other, strict=True)], F.col("_at").alias("_kept"))
    out = rows.join(back, _same([*names, "_at"], [*other, "_kept"]), "left_semi")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("_at").alias(at), F.col("_until").alias(until))
