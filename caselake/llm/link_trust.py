"""URL filtering by rules, and by trust and distrust that spread over the host link graph.

Pages under a rule of the list take its verdict. All others take their host's: trust flows
along links from hosts with allowed pages (personalised PageRank), distrust flows against
links from hosts with blocked pages (the same on the reversed graph: who links to bad hosts
is suspect), and a host whose distrust passes its trust by more than the threshold, per
page, is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the query's rule list: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: Scores are settled when a further round would move less than this part of the seeds in all.
TOLERANCE = 1e-6
ROUNDS_PER_CUT = 4
#: A host is blocked if its distrust is above its trust by more than this part of its pages.
THRESHOLD = 0.5


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #; empty for null and without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path together) that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts, summed; a host's links to itself tell nothing of others."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("href"))
    dst = host_of(F.regexp_replace("href", "^//", "http://"))
    return links.select("src", dst.alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, score) from `edges` (src, dst, share) and `seeds` (host, seed).

    score = (1 - damping) * seed + damping * the shares that arrive; the shares of a host add
    up to 1, and what a host without outgoing links holds stays with it. Scores keep the sum
    of the seeds. A round carries on only what the last one moved. It ends when all that could
    still arrive is less than `tolerance` of the seeds; no score is off by more.
    """
    sources = edges.select(F.col("src").alias("_out")).distinct()
    goes_on = F.col("_out").isNotNull()
    edges = cut(edges.join(sources, F.col("dst") == F.col("_out"), "left").select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "share", goes_on.alias("_on")))
    # What reaches a host without outgoing links adds up there at once: 1 + damping + damping^2 ...
    held = lambda on: F.col("score") * F.when(on, 1.0).otherwise(1 / (1 - damping))
    total = seeds.agg(F.coalesce(F.sum(F.abs("seed")), F.lit(0.0)).alias("n")).first()["n"]
    first = seeds.select("host", ((1 - damping) * F.col("seed")).alias("score")).join(sources, F.col("host") == F.col("_out"), "left")
    score = cut(first.select("host", held(goes_on).alias("score")))
    moved = cut(first.filter(goes_on & (F.col("score") != 0)).select("host", "score"))
    while True:
        left = moved.agg(F.coalesce(F.sum(F.abs("score")), F.lit(0.0)).alias("n")).first()["n"]
        if left * damping <= tolerance * (1 - damping) * total:
            return score
        for _ in range(ROUNDS_PER_CUT):
            sent = moved.join(edges, F.col("host") == F.col("_src"))
            arrived = sent.groupBy(F.col("_dst").alias("host"), "_on").agg((damping * F.sum(F.col("share") * F.col("score"))).alias("score"))
            score = score.unionByName(arrived.select("host", held(F.col("_on")).alias("score")))
            moved = arrived.filter("_on").select("host", "score")
        moved = cut(moved)
        score = cut(score.groupBy("host").agg(F.sum("score").alias("score")))


def host_scores(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, trust, distrust): both in pages, so that one allowed page seeds 1 of trust."""
    found = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    verdict = matching_rule(F.col("host"), F.col("path"), rules)["verdict"]
    own = found.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(verdict == "allow").alias("allowed"), F.count_if(verdict == "block").alias("blocked"))
    links = cut(host_edges(pages, url_col, html_col))
    everyone = own.unionByName(links.select(F.col("dst").alias("host"), *[F.lit(0).cast("long").alias(c) for c in ("pages", "allowed", "blocked")]))
    hosts = cut(everyone.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "allowed", "blocked")]))

    def shares(src: str, dst: str) -> DataFrame:
        e = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "links")
        total = e.groupBy(F.col("src").alias("_src")).agg(F.sum("links").alias("total"))
        return cut(e.join(total, e.src == total._src).select("src", "dst", (F.col("links") / F.col("total")).alias("share")))

    trust = propagate(shares("src", "dst"), hosts.select("host", F.col("allowed").cast("double").alias("seed"))).withColumnRenamed("score", "trust")
    distrust = propagate(shares("dst", "src"), hosts.select("host", F.col("blocked").cast("double").alias("seed"))).withColumnRenamed("score", "distrust")
    return cut(hosts.select("host", "pages").join(trust, "host").join(distrust, "host"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), by_rule.

    A page without a host (null url, or none with ://) has no links that count and is allowed
    unless a rule fits. Rows that repeat an id or url are judged each by itself.
    """
    bad = host_scores(pages, rules, url_col, html_col).filter(F.col("distrust") - F.col("trust") > threshold * F.col("pages")).select(F.col("host").alias("_bad"))
    slim = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    out = slim.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules)).join(bad, F.col("host") == F.col("_bad"), "left")
    by_host = F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")
    return out.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"), F.col("_rule").isNotNull().alias("by_rule"))
