"""Streams give what the batch operators give."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselake.operators.sequence import frame_gap_findings
from caselake.plans import views as V
from caselake.streaming import streams as S


@pytest.fixture(autouse=True)
def no_empty_batches(spark):
    """Processing-time state asks for empty batches without end, to fire its timers."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def parted(spark, df, path, parts, by):
    """Rows as files that arrive one after the other, in order."""
    n = df.count()
    df = df.withColumn("_k", F.ntile(parts).over(Window.orderBy(by)))
    for k in range(1, parts + 1):
        df.filter(F.col("_k") == k).drop("_k").coalesce(1).write.mode("append").parquet(str(path))
    schema = df.drop("_k").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)), n


def test_gaps(spark, sf, tmp_path):
    frames = V.frames(spark, sf).filter("file < 8")
    live, _ = parted(spark, frames, tmp_path / "f", 3, "offset")
    got = sorted(map(tuple, run(S.stream_gap_findings(live), "gaps").collect()), key=repr)
    assert got == sorted(map(tuple, frame_gap_findings(frames).collect()), key=repr) and got


def test_chain(spark, tmp_path):
    rows, head = [], "GENESIS"
    for i in range(6):
        signed = f'{{"n":{i},"previous_entry_sha256":"{head}"}}'
        rows.append(("a", i + 1, signed[:-1] + f',"entry_sha256":"{hashlib.sha256(signed.encode()).hexdigest()}"}}'))
        head = hashlib.sha256(rows[-1][2].encode()).hexdigest()
    bad = [("b", n, r.replace('"n":3', '"n":8')) for _, n, r in rows]
    df = spark.createDataFrame(rows + bad, "lane string, line_no long, raw string")
    live, _ = parted(spark, df, tmp_path / "c", 3, "line_no")
    got = {(r["lane"], r["line_no"]): r["state"] for r in run(S.stream_chain_check(live), "chain").collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", i): "intact" for i in range(1, 7)}
    assert [got[("b", i)] for i in range(1, 7)] == ["intact"] * 3 + ["broken"] * 3


def test_known_hash(spark, sf, tmp_path):
    from caselake.operators.linkage import known_hash_split

    c, h = V.catalog(spark, sf), V.known_hashes(spark, sf)
    live, _ = parted(spark, c, tmp_path / "k", 2, "doc_id")
    got = run(S.stream_known_hash(live, h), "known").groupBy("hash_class").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, known_hash_split(c, h).groupBy("hash_class").count().collect()))


def test_jobs(spark, tmp_path):
    rows = [(1, 1, "running", 5), (1, 3, "done", 9), (1, 2, "running", 7), (2, 1, "running", 1)]
    live, _ = parted(spark, spark.createDataFrame(rows, "job long, seq long, status string, units long"), tmp_path / "j", 1, "seq")
    got = {r["job"]: (r["seq"], r["status"], r["units"]) for r in run(S.stream_job_state(live), "jobs", "update").collect()}
    assert got == {1: (3, "done", 9), 2: (1, "running", 1)}


def test_records_and_overlay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"header":1}\n{"id":"a","source_path":"p2"}\n{"id":"z","sou')
    live = S.stream_records(spark, str(tmp_path / "in"))
    got = run(live, "records")
    assert sorted((r["id"], r["bad_line"]) for r in got.collect() if not r["bad_line"]) == [("a", False)] and got.filter("bad_line").count() == 1
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "ord long, id string, source_path string")
    base.write.parquet(str(tmp_path / "base"))
    (tmp_path / "lines").mkdir()
    spark.createDataFrame([(1, "a", "p2"), (2, "n", "q"), (3, "m", "r")], "line_no long, id string, source_path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
    lines = spark.readStream.schema("line_no long, id string, source_path string").parquet(str(tmp_path / "lines"))
    q = S.stream_overlay(lines, str(tmp_path / "base"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    now = S.overlay_snapshot(spark, str(tmp_path / "out"), str(tmp_path / "base"))
    assert sorted(map(tuple, now.select("ord", "id", "source_path").collect())) == [(1, "a", "p2"), (2, "n", "q"), (5, "m", "r")]


LINE = "line_no long, id string, source_path string"


@pytest.mark.parametrize("share", [0.0, 9.0])
def test_overlay_by_deltas(spark, tmp_path, share):
    """Any rule of merging gives the overlay by all lines; a batch that runs again after a failure does too; old files go."""
    from caselake.operators.linkage import live_overlay

    base = spark.createDataFrame([(i, f"i{i}", f"p{i}") for i in range(200)], "ord long, id string, source_path string")
    base.write.parquet(str(tmp_path / "base"))
    batches = [[(k * 10 + j, f"i{(k * 37 + j * 5) % 230}", f"p{(k * 11 + j) % 260}") for j in range(6)] for k in range(5)]
    want = live_overlay(base, spark.createDataFrame([r for b in batches for r in b], LINE))
    want = sorted(map(tuple, want.select("ord", "id", "source_path").collect()))
    lines, out = tmp_path / "lines", str(tmp_path / "out")
    lines.mkdir()
    live = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(str(lines))
    for k, b in enumerate(batches):
        spark.createDataFrame(b, LINE).coalesce(1).write.mode("append").parquet(str(lines))
        q = S.stream_overlay(live, str(tmp_path / "base"), out, str(tmp_path / "cp"), merge_share=share, most_deltas=3)
        q.processAllAvailable()
        q.stop()
        if k == 3:  # as if the batch had failed before it was committed: it runs again
            (tmp_path / "cp/commits/3").unlink()
            (tmp_path / "cp/commits/.3.crc").unlink(missing_ok=True)
    got = S.overlay_snapshot(spark, out, str(tmp_path / "base")).select("ord", "id", "source_path")
    assert sorted(map(tuple, got.collect())) == want
    kept = {kind: len(list((tmp_path / "out" / kind).glob("0*"))) for kind in ("merged", "deltas", "pointers") if (tmp_path / "out" / kind).exists()}
    assert kept["pointers"] == 2 and kept.get("merged", 0) <= 2 and kept.get("deltas", 0) <= 5
