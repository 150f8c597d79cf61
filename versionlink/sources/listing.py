"""Instructions from a disassembly listing, with their source line and block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from versionlink.functions.text import position_file
from versionlink.operators.asof import asof_backward, asof_inside
from versionlink.sources.logs import ORDER, ordered_lines


def parse_listing(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ordered listing lines into (instructions, positions)."""
    item = F.split(F.regexp_replace("value", r"(?U)\A\s+|\s+\z", ""), ":", 2)
    text = F.regexp_replace(F.get(item, F.lit(1)), r"(?U)\A\s+|\s+\z", "")
    items = lines.where(F.col("value").startswith(" ")).select(
        *ORDER, F.conv(item[0], 16, 10).try_cast("bigint").alias("address"), text.alias("instruction")
    ).where("instruction is not null and address is not null")
    place = F.split(position_file(F.col("value")), ":", 2)
    marks = lines.where(F.col("value").startswith(";")).select(
        *ORDER, F.get(place, F.lit(0)).alias("path"), F.get(place, F.lit(1)).try_cast("bigint").alias("line")
    ).where("line is not null")
    return items, marks


def read_instructions(spark: SparkSession, path, nodes: DataFrame) -> DataFrame:
    """fid, bid, path, line, address, instruction of the items inside known blocks.

    A gzip listing is one split; large ones are better stored in pieces.
    """
    items, marks = parse_listing(ordered_lines(spark, path))
    placed = asof_backward(items, marks, ORDER, ["path", "line"]).where("path is not null")
    inside = asof_inside(placed, nodes, "address", "start_address", "end_address", ["fid", "bid"])
    return inside.select("fid", "bid", "path", "line", "address", "instruction")
