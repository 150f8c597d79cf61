"""Tables from the tagged text log of one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from versionlink.functions.text import normal_path, signed
from versionlink.session import settle

# Fixed line tags of the log format; the word before the dash names the writing tool.
INFO_TAG, COUNTS_TAG, PROFILE_TAG = r"\A\w+-LineInfo#", r"\A\w+-Counts: ", r"\A  - name:"
ORDER = ["file", "block_start", "row"]


def tagged_lines(spark: SparkSession, path, tag: str) -> DataFrame:
    """Lines of a text file that start with a tag (a pattern)."""
    return spark.read.text(path).where(F.col("value").rlike(tag))


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with an order key: file, start of the split they were read in, row in it.

    Rows of a split are read in file order, so the key needs no extra job and
    works for compressed files too.
    """
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_profiled_names(spark: SparkSession, path) -> DataFrame:
    """Function names of a profile."""
    name = F.regexp_replace(F.regexp_replace("value", r"\A  - name:\s+", ""), "'", "")
    return tagged_lines(spark, path, PROFILE_TAG).select(name.alias("func"))


def read_function_info(spark: SparkSession, path) -> DataFrame:
    part = lambda i: F.get(F.split("value", "#", 12), F.lit(i))
    chunk = F.regexp_extract("func", r"\A[^/]*/(?s)(.*)\z", 1)
    return tagged_lines(spark, path, INFO_TAG).select(
        part(1).alias("func"), part(2).alias("namespace"), part(3).alias("basename"),
        part(4).alias("parameters"), part(5).alias("extension"), normal_path(part(6)).alias("file"),
        part(7).try_cast("bigint").alias("line"), part(8).try_cast("bigint").alias("column"),
        part(9).alias("id"), part(10).alias("hash"), part(11).alias("nblocks"),
    ).withColumn("chunk", F.when(F.col("func").contains("/"), chunk).otherwise("1"))


def with_line_rank(info: DataFrame) -> DataFrame:
    """Dense rank of the line inside its file."""
    lines = info.select("file", "line").distinct()
    window = Window.partitionBy("file").orderBy("line")
    return info.join(lines.withColumn("rank", F.dense_rank().over(window)), ["file", "line"])


def _counts(spark: SparkSession, path) -> DataFrame:
    fields = F.split("value", " ", 3)
    return tagged_lines(spark, path, COUNTS_TAG).select(
        F.get(fields, F.lit(1)).alias("kind"), F.get(fields, F.lit(2)).alias("v")
    )


def _of_kind(spark: SparkSession, path, parsed: DataFrame | None, kind: str) -> DataFrame:
    return (_counts(spark, path) if parsed is None else parsed).where(F.col("kind") == kind)


def _block(text, i: int):
    return F.get(F.split(text, "#", 2), F.lit(i)).try_cast("bigint")


def read_functions(spark: SparkSession, path, parsed: DataFrame | None = None) -> DataFrame:
    """fid, func, count; one row per alias name."""
    f = F.split("v", " ", 5)
    names = F.split(F.regexp_replace(f[0], r",+\z", ""), ",")
    return _of_kind(spark, path, parsed, "func").select(
        f[2].try_cast("bigint").alias("fid"), F.explode(names).alias("func"), signed(f[1]).alias("count")
    )


def read_nodes(spark: SparkSession, path, parsed: DataFrame | None = None) -> DataFrame:
    f = F.split("v", " ", 6)
    rows = _of_kind(spark, path, parsed, "node").select(
        _block(f[0], 0).alias("fid"), _block(f[0], 1).alias("bid"), f[2].try_cast("bigint").alias("start"),
        f[3].try_cast("bigint").alias("end"), signed(f[4]).alias("hash"), f[5].try_cast("bigint").alias("insns"),
        signed(f[1]).alias("count"),
    )
    return rows.select(
        "fid", "bid", (F.col("start") + F.col("fid")).alias("start_address"),
        (F.col("end") + F.col("fid")).alias("end_address"), "hash", "insns", "count",
    )


def read_edges(spark: SparkSession, path, parsed: DataFrame | None = None) -> DataFrame:
    f = F.split("v", " ", 3)
    return _of_kind(spark, path, parsed, "edge").select(
        _block(f[0], 0).alias("src_fid"), _block(f[0], 1).alias("src_bid"),
        _block(f[1], 0).alias("dst_fid"), _block(f[1], 1).alias("dst_bid"),
    )


def read_graph(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, nodes, edges) of one log, which is scanned once."""
    parsed = settle(_counts(spark, path))
    return read_functions(spark, path, parsed), read_nodes(spark, path, parsed), read_edges(spark, path, parsed)
