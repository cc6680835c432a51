"""Session helpers: reachable workers, the shared folder, cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed but lies on the driver's path."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``, which all executors share; below a temporary folder only where that is unset and the master is local."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="shared-")
        _folders[app] = f"{folder.rstrip('/')}/{app}"
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, read again: lineage ends there."""
    spark = reachable(df.sparkSession)
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
