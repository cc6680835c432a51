"""The plan that draws surrogates stays small: it once held a copy of each step for each use of it, 1.5 million nodes."""

from __future__ import annotations

from caselake.llm.surrogates import OWN_LENGTH, candidate


def test_plan_size(spark):
    entities = spark.createDataFrame([("email", "a@b.example", None, None), ("card", "4111111111111111", None, None)], "kind string, norm string, first boolean, gender string")
    for attempt in (0, OWN_LENGTH + 1):
        drawn = candidate(entities, attempt, "key")
        plan = drawn._jdf.queryExecution()
        assert plan.optimizedPlan().toJSON().count('"class"') < 30_000
        assert plan.analyzed().toJSON().count('"class"') < 30_000
        assert drawn.select("surrogate").distinct().count() == 2
