"""Keyed streams hand many keys' rows and states to Python at once."""

from pyspark.sql import functions as F

from caselake.streaming import streams as T


def test_states_travel_with_their_rows(spark):
    rate = spark.readStream.format("rate").load().select(F.col("value").alias("n"))
    frames = T.stream_gap_findings(rate.select(F.col("n").alias("file"), F.col("n").alias("channel"), F.col("n").alias("offset"), F.col("n").alias("seconds")))
    jobs = T.stream_job_state(rate.select(F.col("n").alias("job"), F.col("n").alias("seq"), F.lit("running").alias("status"), F.col("n").alias("units")))
    for df in (frames, jobs):
        assert "FlatMapGroupsInPandasWithState" in df._jdf.queryExecution().analyzed().toString()
