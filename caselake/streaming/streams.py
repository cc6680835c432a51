"""The live forms: records as they arrive, overlays, chain checks, gaps, job states.

Watermarks and timers only free state; nothing is decided by event time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lanes import CHAINED, GENESIS, LINE
from ..operators.linkage import clean_hash, live_overlay
from ..operators.sequence import FRAME_GAP_SECONDS
from ..sources.chunks import opened
from ..sources.readers import records_from_lines


def stream_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines as files arrive; header lines (without id) go, torn lines stay with bad_line for the counts."""
    lines = spark.readStream.text(path).filter("trim(value) <> ''")
    parsed = records_from_lines(lines)
    return parsed.filter(F.col("bad_line") | (F.coalesce("id", F.lit("")) != "")).observe("stream_records", F.count(F.lit(1)).alias("lines"), F.count_if(F.col("bad_line")).alias("bad_lines"))


POINTER = "generation long, merged string, merged_rows long, deltas array<string>, delta_rows long"
#: Deltas are merged when they hold more than this share of the rows merged before, or are more than so many.
MERGE_SHARE, MOST_DELTAS = 0.5, 16


def _pointers(spark: SparkSession, out_path: str) -> list:
    """The two newest published pointers, newest first; none before the first batch."""
    try:
        return spark.read.schema(POINTER).option("recursiveFileLookup", "true").parquet(f"{out_path}/pointers").orderBy(F.desc("generation")).limit(2).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _last_lines(lines: DataFrame) -> DataFrame:
    """Of each id's lines the last."""
    return lines.groupBy("id").agg(F.max_by(F.struct(*lines.columns), "line_no").alias("_last")).select("_last.*")


def overlay_snapshot(spark: SparkSession, out_path: str, base_path: str) -> DataFrame:
    """The base overlaid by the lines of all batches that `stream_overlay` has published below `out_path`."""
    base, newest = spark.read.parquet(base_path), _pointers(spark, out_path)
    if not newest:
        return base
    parts = [*([newest[0]["merged"]] if newest[0]["merged"] else []), *newest[0]["deltas"]]
    return live_overlay(base, spark.read.parquet(*parts)) if parts else base


def stream_overlay(live: DataFrame, base_path: str, out_path: str, checkpoint: str, merge_share: float = MERGE_SHARE, most_deltas: int = MOST_DELTAS):
    """Start a query that keeps the live records that overlay a base: line_no (their line in the growing log), id, source_path, ...

    A batch writes a delta, in proportion to its own rows, and then publishes a pointer: one row
    that names the merged lines and the deltas since. Readers (`overlay_snapshot`) follow the newest
    pointer and overlay the base with all these lines at once; the base is never written. When
    the deltas outgrow the merged lines (`merge_share`, `most_deltas`), they become one table of
    each id's last line, so that a line is rewritten a few times at most, however many batches
    come. Files are named by the batch, so that a batch that failed and runs again writes the same
    state. What neither the newest pointer nor the one before it names is removed once the
    pointer is out; readers of older ones must start anew.
    """

    def step(batch: DataFrame, generation: int) -> None:
        spark = batch.sparkSession
        known = [p for p in _pointers(spark, out_path) if p["generation"] < generation]
        merged, merged_rows, deltas, delta_rows = (known[0]["merged"], known[0]["merged_rows"], known[0]["deltas"], known[0]["delta_rows"]) if known else (None, 0, [], 0)
        delta = f"{out_path}/deltas/{generation:012d}"
        batch.write.mode("overwrite").parquet(delta)
        deltas, delta_rows = [*deltas, delta], delta_rows + spark.read.parquet(delta).count()
        if delta_rows > merge_share * merged_rows or len(deltas) > most_deltas:
            new = f"{out_path}/merged/{generation:012d}"
            _last_lines(spark.read.parquet(*([merged] if merged else []), *deltas)).write.mode("overwrite").parquet(new)
            merged, merged_rows, deltas, delta_rows = new, spark.read.parquet(new).count(), [], 0
        row = spark.createDataFrame([(generation, merged, merged_rows, deltas, delta_rows)], POINTER)
        row.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/pointers/{generation:012d}")
        named = {merged, *deltas, *([known[0]["merged"], *known[0]["deltas"], f"{out_path}/pointers/{known[0]['generation']:012d}"] if known else [])}
        for kind in ("merged", "deltas", "pointers"):
            system, path = opened(f"{out_path}/{kind}")
            for old in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if int(old.base_name) < generation and f"{out_path}/{kind}/{old.base_name}" not in named:
                    system.delete_dir(old.path)

    return live.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def stream_known_hash(arriving: DataFrame, hashes: DataFrame) -> DataFrame:
    """The known-hash classes of arriving records; the list is a static table."""
    listed = hashes.select(clean_hash(F.col("sha256")).alias("_known")).distinct()
    own = clean_hash(F.col("sha256"))
    out = arriving.join(listed, own == F.col("_known"), "left")
    return out.withColumn("hash_class", F.when(own.isNull(), "unhashed").when(F.col("_known").isNotNull(), "known").otherwise("unknown")).drop("_known")


class ChainCheck(StatefulProcessor):
    """Per lane: the last hash and line number; emits each arriving line's verdict."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "head string, line_no long, broken boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, line_no, broken = self.last.get() if self.last.exists() else (GENESIS, 0, False)
        out = []
        frames = list(rows)
        for row in pd.concat(frames).sort_values("line_no").itertuples() if frames else []:
            m = re.fullmatch(LINE, row.raw, re.DOTALL)
            chained = re.fullmatch(CHAINED, m.group(1), re.DOTALL) if m else None
            ok = bool(m and chained) and row.line_no == line_no + 1 and chained.group(1) == head and hashlib.sha256((m.group(1) + "}").encode()).hexdigest() == m.group(2)
            broken = broken or not ok
            out.append((key[0], row.line_no, "broken" if broken else "intact"))
            head, line_no = hashlib.sha256(row.raw.encode()).hexdigest(), row.line_no
        self.last.update((head, int(line_no), broken))
        yield pd.DataFrame(out, columns=["lane", "line_no", "state"])

    def close(self) -> None:
        pass


def stream_chain_check(lines: DataFrame) -> DataFrame:
    """lane, line_no, state of arriving lines (lane, line_no, raw); lines of a lane arrive in order of batches."""
    return lines.groupBy("lane").transformWithStateInPandas(ChainCheck(), "lane string, line_no long, state string", "Append", "None")


def stream_gap_findings(frames: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """The frame gap findings of arriving frames (file, channel, offset, seconds). The state of a (file, channel) is its last frame's time; an invalid date forgets it, and `ttl_ms` without frames frees it."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        found = pd.concat(list(batches)).sort_values("offset", kind="stable")
        seconds = found["seconds"].astype("Int64")
        delta = seconds - pd.concat([pd.Series([before], dtype="Int64"), seconds.iloc[:-1]]).set_axis(seconds.index)
        kind = np.select([seconds.isna(), (delta < 0).fillna(False), (delta > FRAME_GAP_SECONDS).fillna(False)], ["invalid-date", "regression", "gap"], "")
        if not pd.isna(seconds.iloc[-1]):
            state.update((int(seconds.iloc[-1]),))
            state.setTimeoutDuration(ttl_ms)
        elif state.exists:
            state.remove()
        if (kind != "").any():
            yield found.assign(kind=kind, delta=delta)[["file", "channel", "offset", "kind", "delta"]][kind != ""]

    return frames.select("file", "channel", "offset", "seconds").groupBy("file", "channel").applyInPandasWithState(check, "file long, channel long, offset long, kind string, delta long", "seconds long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_job_state(events: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """job, seq, status, units: the latest state of each job whenever its events (job, seq, status, units) arrive. Liveness is by heartbeat timeout: a running job without a sign of life for `timeout_ms` is interrupted."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, units = state.get if state.exists else (-1, "unknown", 0)
        if state.hasTimedOut:
            status = "interrupted"
        else:
            for batch in batches:
                new = batch.loc[batch["seq"].idxmax()] if batch["seq"].notna().any() else None
                if new is not None and new["seq"] > seq:
                    seq, status, units = int(new["seq"]), new["status"], int(new["units"])
        state.update((seq, status, units))
        if status == "running":
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], seq, status, units)], columns=["job", "seq", "status", "units"])

    return events.select("job", "seq", "status", "units").groupBy("job").applyInPandasWithState(follow, "job long, seq long, status string, units long", "seq long, status string, units long", "update", GroupStateTimeout.ProcessingTimeTimeout)
