"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution (skew joins, partition coalescing)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Panels are small in bytes and heavy in work per row: let small partitions stay apart.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a fresh local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current.rsplit("/", 1)[0] if "/" in current else current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="tidewater-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def spread(df, *keys):
    """Hash rows over all shuffle partitions ahead of a costly Python stage.

    Without this, adaptive execution judges the stage by its bytes and may give it to a single task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(df):
    """Write a small intermediate table to the shared folder and continue from the files.

    A table read back has the size of its files. A checkpointed frame keeps the estimates of the plan
    it came from, which multiply with every join of a loop until planning takes longer than the work.
    """
    path = scratch_path(df.sparkSession, "pass")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
