"""The corpus pipeline and the registered queries on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns + ["shard"] * (k == len(P.STAGES) - 1), name
        out.write.parquet(str(tmp_path / f"{k}"))
        new = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 3:
            assert 0 < new.count() <= before
            assert new.join(docs, "doc_id", "left_anti").count() == 0
        docs, before = new, new.count()
    assert docs.filter("shard is null or shard not between 0 and 7").count() == 0


def test_first_stage_agrees_with_the_scores(spark, sf):
    import corpus_pipeline as P
    from caselake.llm import queries, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stay = {r[0] for r in P.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert stay == {r["doc_id"] for r in queries.op3_toxicity(spark, sf).collect() if r["predicted"] == 0}
    assert toxicity.MOST_TERMS > 0


def test_mixing_agrees_with_duckdb(spark, sf):
    from caselake.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = ORACLES["op8_mix_sources"]
    there = [d[0] for d in c.sql(f"DESCRIBE {sql}").fetchall()]
    want = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in c.sql(sql).fetchall())
    got = QUERIES["op8_mix_sources"](spark, sf).select(*there).collect()
    assert sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got) == want


@pytest.mark.parametrize("name,columns", [
    ("op2_embedding_dedup", {"vec_id", "n_links", "component_id", "kept"}), ("op4_simhash_dedup", {"doc_id", "fingerprint", "component_id"}),
    ("op9_url_filter", {"page_id", "host", "path", "rule", "verdict"}), ("op10_shard", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
])
def test_contract_columns(spark, sf, name, columns):
    from caselake.llm.queries import QUERIES

    df = QUERIES[name](spark, sf)
    assert columns <= set(df.columns) and df.filter(F.lit(True)).count() > 0
