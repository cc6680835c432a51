"""The flagship query: one pass of triage over a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linkage import known_hash_split
from ..operators.sequence import mark_duplicates, timestamp_findings
from . import views as V
from .registry import query


@query("triage_summary", f"""WITH {V.CATALOG}, {V.KNOWN}, d AS (SELECT parent_dir, id, modified_unix - lag(modified_unix) OVER (PARTITION BY parent_dir ORDER BY source_path, id) AS delta FROM catalog WHERE modified_unix > 0),
f AS (SELECT id, CASE WHEN delta < 0 THEN 'regression' ELSE 'gap' END AS kind FROM d WHERE delta < 0 OR delta > 604800), u AS (SELECT *, first(id) OVER (PARTITION BY sha256 ORDER BY doc_id, id) AS fi FROM catalog)
SELECT u.source, u.lang, count(*) AS records, count(*) FILTER (u.sha256 IN (SELECT sha256 FROM known)) AS known, count(*) FILTER (u.sha256 IS NULL) AS unhashed, count(*) FILTER (u.sha256 IS NOT NULL AND fi <> u.id) AS duplicates,
  count(*) FILTER (f.kind = 'gap') AS gaps, count(*) FILTER (f.kind = 'regression') AS regressions FROM u LEFT JOIN f ON u.id = f.id GROUP BY u.source, u.lang""")
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and language: records by hash class, duplicates, gaps and regressions in time."""
    c = V.catalog(spark, sf_dir)
    marked = mark_duplicates(known_hash_split(c, V.known_hashes(spark, sf_dir)), ["doc_id"])
    found = timestamp_findings(c).select("id", F.col("kind").alias("finding"))
    j = marked.join(found, "id", "left")
    return j.groupBy("source", "lang").agg(
        F.count("*").alias("records"), F.count_if(F.col("hash_class") == "known").alias("known"), F.count_if(F.col("hash_class") == "unhashed").alias("unhashed"),
        F.count("duplicate_of").alias("duplicates"), F.count_if(F.col("finding") == "gap").alias("gaps"), F.count_if(F.col("finding") == "regression").alias("regressions"),
    )
