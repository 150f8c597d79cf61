"""Readers of link tables and lists; the last row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from versionlink.sources.logs import ORDER, ordered_lines

TOMBSTONE = -1


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*key, *ORDER)]
    last = F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("__last")
    return rows.groupBy(*key).agg(last).select(*key, "__last.*")


def _field(fields, i: int):
    return F.get(fields, F.lit(i))


def read_function_map(spark: SparkSession, path) -> DataFrame:
    """old_func, new_func; only the first comma splits."""
    f = F.split("value", ",", 2)
    rows = ordered_lines(spark, path).select(*ORDER, _field(f, 0).alias("old_func"), _field(f, 1).alias("new_func"))
    return _last(rows.where("new_func is not null and new_func <> ''"), ["old_func"])


def read_block_map(spark: SparkSession, path) -> DataFrame:
    f = F.split("value", ",")
    rows = ordered_lines(spark, path).select(
        *ORDER, _field(f, 0).alias("old_func"), _field(f, 1).try_cast("bigint").alias("old_bid"),
        _field(f, 2).try_cast("bigint").alias("new_bid"),
    )
    return _last(rows.where("old_bid is not null and new_bid is not null"), ["old_func", "old_bid"])


def read_cross_map(spark: SparkSession, path, new_names: DataFrame, old_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cross links, rejected lines). Both names must exist (``func`` tables)."""
    f = F.split("value", ",")
    rows = ordered_lines(spark, path).select(
        "value", *ORDER, _field(f, 0).alias("new_func"), _field(f, 1).try_cast("bigint").alias("new_bid"),
        _field(f, 2).alias("old_func"), _field(f, 3).try_cast("bigint").alias("old_bid"),
    )
    good = rows.where("new_bid is not null and old_bid is not null")
    good = good.join(new_names.select(F.col("func").alias("new_func")).distinct(), "new_func", "left_semi")
    good = good.join(old_names.select(F.col("func").alias("old_func")).distinct(), "old_func", "left_semi")
    rejected = rows.join(good.select(*ORDER), ORDER, "left_anti").select("value")
    # a later row for the same old block of the same new function replaces the target
    links = _last(good.drop("value"), ["new_func", "old_func", "old_bid"])
    return links.select("new_func", "new_bid", "old_func", "old_bid"), rejected


def with_tombstones(block_map: DataFrame, cross: DataFrame) -> DataFrame:
    """Block map in which blocks linked across functions lead nowhere."""
    key = ["old_func", "old_bid"]
    dead = cross.select(*key).distinct().withColumn("new_bid", F.lit(TOMBSTONE).cast("bigint"))
    return block_map.join(dead.select(*key), key, "left_anti").unionByName(dead)


def read_function_places(spark: SparkSession, path) -> DataFrame:
    """func, path, line from ``path,line,func`` rows with an all-digit line."""
    f = F.split("value", ",")
    rows = ordered_lines(spark, path).select(
        *ORDER, _field(f, 0).alias("path"), _field(f, 1).alias("digits"), _field(f, 2).alias("func")
    )
    rows = rows.where(F.col("func").isNotNull() & F.col("digits").rlike(r"\A\d+\z"))
    return _last(rows.select(*ORDER, "func", "path", F.col("digits").cast("bigint").alias("line")), ["func"])


def without_skipped(functions: DataFrame, names: DataFrame) -> DataFrame:
    """Functions none of whose names is listed (``func``)."""
    listed = functions.join(names.select("func"), "func", "left_semi").select("fid")
    return functions.join(listed, "fid", "left_anti")


def read_names(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("func"))
