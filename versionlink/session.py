"""Lineage cuts shared by every loop of the package.

Loops cut their lineage with reliable checkpoints, so a lost executor costs one
round at most. The folder is the one the cluster names in
``spark.checkpoint.dir``; only a local session without that setting (a test)
gets a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="versionlink-")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors reach, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


# Seconds between two collections of the driver's garbage.
RELEASE_EVERY = 3.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles and checkpoints of plans that nobody holds any more.

    Else they stay until the driver happens to collect its garbage, and a long query fills the disk.
    """
    global _released
    if time.monotonic() - _released < RELEASE_EVERY:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from its reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """As :func:`settle`, for large tables: compressed columns in place of plain rows.

    The files lie in the folder of an empty checkpoint that stays part of the plan, so they go
    when that checkpoint does. Partitions are not those of ``df``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    release(spark)
    holder = df.limit(0).checkpoint(eager=True)
    folder = f"{holder._jdf.queryExecution().logical().rdd().getCheckpointFile().get()}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder).unionByName(holder)


def union_all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def empty_like(df: DataFrame, *columns: str) -> DataFrame:
    """An empty table with the types of ``columns`` (all when none are named)."""
    schema = df.select(*columns).schema if columns else df.schema
    return df.sparkSession.createDataFrame([], schema)


def compact(parts: list[DataFrame], most: int = 6) -> list[DataFrame]:
    """Merge many small settled tables into one, so later rounds read few partitions."""
    if len(parts) <= most:
        return parts
    whole = union_all(parts)
    return [settle(whole.repartition(*whole.columns))]
