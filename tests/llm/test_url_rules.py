"""The URL filter's rules against the contract's list, word by word."""

from pyspark.sql import functions as F

from caselake.llm import link_trust

#: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_rules_are_the_contracts():
    assert {host + path: verdict for verdict, host, path in link_trust.RULES} == CONTRACT
    assert len(link_trust.RULES) == len(CONTRACT)


def test_verdicts_of_each_rule(spark):
    urls = {"http://a.com/en/1": "com/en/", "http://q.example.com/en/7": "example.com/en/7", "http://a.net/de/8": "net/de/", "http://example.net/de/7": "net/de/", "http://x.example.net/de/8": "example.net/de/8", "http://a.org/es/": "org/es/"}
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in link_trust.judge_urls(df).select("page_id", F.col("rule"), "verdict").collect()}
    assert got == {k: (rule, CONTRACT[rule]) for k, rule in enumerate(urls.values())}
