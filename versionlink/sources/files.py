"""Paths and source lines from folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from versionlink.functions.text import code_lines


def read_paths(spark: SparkSession, folders: list[str]) -> DataFrame:
    """All regular files below the folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return files.select(F.regexp_replace("path", r"\Afile:(//)?", "").alias("path"))


def split_sources(texts: DataFrame) -> DataFrame:
    """path, line, code of whole source texts (``path, text``), block comments removed."""
    lines = texts.select("path", F.explode(code_lines(F.col("text"))).alias("l"))
    return lines.select("path", "l.line", "l.code")


def read_sources(spark: SparkSession, paths: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Code lines of source files, one file per input row.

    With ``wanted`` (``path``) only those files are opened: the listing is joined with the wanted paths, and
    the reader is given the list that is left. The driver holds that list, as it does the file
    listing of any read.
    """
    if wanted is not None:
        listed = read_paths(spark, paths).join(wanted.select("path").distinct(), "path", "left_semi")
        paths = [re.sub(r"([*?{}\[\]\\])", r"\\\1", r["path"]) for r in listed.collect()]  # names, not patterns
        if not paths:
            return split_sources(spark.createDataFrame([], "path string, text string"))
    texts = spark.read.text(paths, wholetext=True, recursiveFileLookup=wanted is None)
    # a URI with encoded signs, in which a plus is itself
    path = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"\Afile:(//)?", ""), F.lit("+"), F.lit("%2B")))
    return split_sources(texts.select(path.alias("path"), F.col("value").alias("text")))
