"""Helpers shared by the operators: tables, stored intermediates, text batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlink.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; a lower setting of the session stays."""
    now = int(spark.conf.get(BATCH_SETTING, str(BATCH_BYTES)))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written table.

    The written table cuts the lineage, survives lost executors and keeps the
    columns prunable. What earlier steps shuffled is released first.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    release(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(text: str = "text", doc_id: str = "doc_id"):
    """A key that equal rows share and other rows do not: the id and the text's hash."""
    return F.xxhash64(F.lit("row"), F.col(doc_id), F.col(text))


def wide_key(text: str = "text", doc_id: str = "doc_id"):
    """As :func:`row_key`, in 128 bits, for keys that decide which rows go: 1e11 rows share one by a chance of 1e-17."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\0", part(doc_id), part(text)).cast("binary")))


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty), about ``most`` bytes each.

    The slice bounds what an operator holds at a time, whatever the batch size; a
    single longer text makes a slice of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        first, size, texts = 0, 0, []
        for row, value in enumerate(column):
            text = value.as_py() or b""
            if texts and size + len(text) > most:
                yield batch.slice(first, row - first), texts
                first, size, texts = row, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(first), texts
