"""Finding benchmark items inside documents, in SQL functions only.

A document is contaminated by an item if some window of it, as many words long as the item,
has a weighted Jaccard similarity of 0.8 or more with it over 5-word shingles (repeats
weigh by their number). Words are runs of letters and digits in lower case.

1. *Windows.* A similarity t needs t times the item's shingles in the document. Shingles are
   looked up among the items', and only where enough are found is there a window to look at:
   its start follows from where a found shingle stands in both, or lies between two of these.
   This loses no window that reaches t, and leaves few. A window is a place and a length; what
   item it may hold is not asked yet.
2. *Fingerprints.* Each window and item gets a 128-bit SimHash of its shingles, two blocks of 64
   bits. Two that differ in 40 bits or fewer differ in 20 or fewer in a block, which one window
   in 400 does by chance; windows and items of one length that do are compared whole, so all
   fingerprints within 40 bits are found. Similarity 0.8 has an angle of 27 degrees: 19 bits in
   the mean, and more than 40 about three times in ten million.
3. *Verification.* Pairs within 40 bits are compared shingle by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, unused

WIDTH = 5
LEAST = 0.8
RADIUS = 40
#: The items' shingles are broadcast if they are counted to be this many at most (about 40 bytes each).
BROADCAST_SHINGLES = 500_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, width: Column | int) -> Column:
    """The hashes of the runs of `width` words; empty if there are fewer."""
    width = F.lit(width) if isinstance(width, int) else width
    starts = F.sequence(F.lit(1), F.size(words) - width + 1)
    return F.when(F.size(words) >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits, each set if it is set in more than half of the hashes."""

    def bit(acc: Column, b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1))
        power = F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        return acc.bitwiseOR(F.when(2 * ones > F.size(hashes), power).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)


def fingerprint(hashes: Column) -> Column:
    """Two blocks of 64 bits."""
    return F.array(simhash(hashes), simhash(F.transform(hashes, lambda h: F.xxhash64(h))))


def within(ours: Column, theirs: Column, radius: int = RADIUS) -> Column:
    """True for fingerprints that differ in `radius` bits at most: one block within half of it, then both together."""
    bits = [F.bit_count(ours[k].bitwiseXOR(theirs[k])) for k in (0, 1)]
    return ((bits[0] <= radius // 2) | (bits[1] <= radius // 2)) & (bits[0] + bits[1] <= radius)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays as multisets."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text, in 128 bits; equal rows share it, and the verdict."""
    return F.struct(F.xxhash64(docs[id_col], docs[text_col]).alias("a"), F.xxhash64(F.lit("again"), docs[text_col], docs[id_col]).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(row_key, item, similarity): each item that a row's text holds, with its best window's similarity.

    An item with fewer than five words is one shingle of all its words; one without words is
    in no document. Null texts hold nothing.
    """
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text)).alias("_w"))
    items = items.withColumns({"n": F.size("_w"), "width": F.least(F.size("_w"), F.lit(WIDTH))}).filter("n > 0")
    items = cut(items.select("item", "n", "width", shingles(F.col("_w"), F.col("width")).alias("theirs")).withColumn("fp", fingerprint(F.col("theirs"))))
    places = items.select("item", "n", "width", F.size("theirs").alias("of"), F.posexplode("theirs").alias("at", "hash"))
    few = places.count() <= BROADCAST_SHINGLES
    small = F.broadcast if few else lambda df: df
    rows = docs.select(row_key(docs, id_col, text_col).alias("row_key"), word_hashes(docs[text_col]).alias("_w"))

    found = None
    for width in sorted(r["width"] for r in items.select("width").distinct().collect()):
        there = rows.select("row_key", F.posexplode(shingles(F.col("_w"), width)).alias("pos", "hash"))
        hits = there.join(small(places.filter(F.col("width") == width)), "hash").select("row_key", "item", "n", "width", "of", "pos", (F.col("pos") - F.col("at")).alias("start"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"row_key struct<a:long,b:long>, item {dict(benchmark.dtypes)[item_col]}, similarity double")

    lines = found.groupBy("row_key", "item", "n", "width", "of").agg(F.count_distinct("pos").alias("hits"), F.array_sort(F.collect_set("start")).alias("starts"))
    lines = lines.filter(F.col("hits") >= least * F.col("of"))
    before = F.lag("start").over(Window.partitionBy("row_key", "item").orderBy("start"))
    lines = lines.select("row_key", "item", "n", "width", F.explode("starts").alias("start")).withColumn("before", before)
    between = F.when(F.col("start") - F.col("before") <= F.col("n"), F.sequence(F.col("before") + 1, F.col("start"))).otherwise(F.array("start"))
    starts = lines.select("row_key", "n", "width", F.explode(between).alias("start"))
    starts = starts.select("row_key", "n", "width", F.greatest("start", F.lit(0)).alias("start")).distinct()
    wanted = cut(starts)
    near = cut(wanted.select("row_key").distinct())
    near = small(near) if near.count() <= BROADCAST_SHINGLES // 50 else near
    # Texts meet the few rows before their words are hashed again.
    texts = docs.select(row_key(docs, id_col, text_col).alias("row_key"), docs[text_col].alias("_text")).join(near, "row_key", "left_semi").dropDuplicates(["row_key"])
    texts = cut(texts.select("row_key", word_hashes(F.col("_text")).alias("_w")))
    windows = wanted.join(texts, "row_key").select("row_key", "n", "width", F.slice("_w", F.col("start") + 1, F.col("n")).alias("_w"))
    windows = windows.select("row_key", "n", shingles(F.col("_w"), F.col("width")).alias("ours")).filter("size(ours) > 0").distinct()
    windows = cut(windows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_key", "ours").withColumn("fp", fingerprint(F.col("ours"))))
    theirs = items.select("item", F.col("n").alias("_n"), "theirs", F.col("fp").alias("_fp"))
    pairs = windows.join(small(theirs), (F.col("n") == F.col("_n")) & within(F.col("fp"), F.col("_fp")))
    exact = pairs.select("row_key", "item", similarity(F.col("ours"), F.col("theirs")).alias("similarity")).filter(F.col("similarity") >= least)
    return exact.groupBy("row_key", "item").agg(F.max("similarity").alias("similarity"))


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, contaminated, items (sorted), similarity (the highest; null if clean)."""
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text)
    found = cut(found.groupBy(F.col("row_key").alias("_row")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity")))
    out = docs.select(docs[id_col], row_key(docs, id_col, text_col).alias("_key")).join(found, F.col("_key") == F.col("_row"), "left")
    return out.select(id_col, F.col("_row").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(f"array<{dict(benchmark.dtypes)[item_col]}>")).alias("items"), "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a benchmark item."""
    row = unused(docs, "_row")
    found = cut(contaminated(docs.select(id_col, text_col), benchmark, id_col, text_col).select(F.col("row_key").alias(row)).distinct())
    if found.count() <= BROADCAST_SHINGLES // 50:
        found = F.broadcast(found)
    return docs.join(found, row_key(docs, id_col, text_col) == F.col(row), "left_anti")
