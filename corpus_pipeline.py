"""The corpus pipeline: clean, deduplicate, decontaminate, mix and shard the documents.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows the one before kept and is
written and read again in between. All but the last return the columns of
documents. ``ORACLE_SQL`` is None: banded alignment and differencing are no SQL; the tests
hold the pipeline against plain Python instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versionlink.llm import decontamination, lines, minhash, sampling, sharding
from versionlink.llm.common import stored, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and rejected documents go."""
    return lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8)."""
    return minhash.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return sampling.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in sixteen shards of near-equal bytes."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
