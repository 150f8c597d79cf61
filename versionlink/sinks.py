"""Link tables, logs and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TOOL = "Log"  # the word before the dash of a line tag
PAIR = ["old_fid", "new_fid"]


def function_rows(func_map: DataFrame) -> DataFrame:
    return func_map.select("old_func", "new_func")


def block_rows(bb_map: DataFrame, func_map: DataFrame) -> DataFrame:
    """Block links of linked functions, by old name and block."""
    rows = bb_map.join(func_map.select(*PAIR, "old_func"), PAIR)
    return rows.select("old_func", "old_bid", "new_bid").orderBy("old_func", "old_bid")


def cross_rows(bb_map: DataFrame, func_map: DataFrame, multi_map: DataFrame) -> DataFrame:
    """Block links of function pairs that are secondary links only."""
    rows = bb_map.join(func_map.select(*PAIR), PAIR, "left_anti").join(multi_map, PAIR)
    columns = ["new_func", "new_bid", "old_func", "old_bid"]
    return rows.select(*columns).orderBy(*columns)


def write_rows(rows: DataFrame, path: str) -> None:
    """Write a link table; a rerun, also after a write that was killed, leaves one copy."""
    rows.write.mode("overwrite").csv(path, header=False)


def info_lines(info: DataFrame) -> DataFrame:
    """Tagged text lines of a function info table."""
    fields = ["func", "namespace", "basename", "parameters", "extension", "file", "line", "column", "id", "hash", "nblocks"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    return info.select(F.concat_ws("#", F.lit(f"{TOOL}-LineInfo"), *text).alias("value"))


def graph_lines(functions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tagged text lines of functions (one per fid), nodes and edges (``count`` optional)."""
    unsigned = lambda c: F.conv(F.col(c).cast("string"), 10, 16)
    plain = lambda c: F.conv(unsigned(c), 16, 10)
    line = lambda kind, *parts: F.concat_ws(" ", F.lit(f"{TOOL}-Counts:"), F.lit(kind), *parts).alias("value")
    block = lambda s: F.concat_ws("#", F.col(f"{s}fid"), F.col(f"{s}bid"))
    names = functions.groupBy("fid").agg(
        F.concat(F.array_join(F.array_sort(F.collect_list("func")), ","), F.lit(",")).alias("names"),
        F.max("count").alias("count"),
    )
    funcs = names.select(line("func", F.col("names"), plain("count"), F.col("fid"),
                              (F.col("count") >= 0).cast("int").cast("string"), F.lit("0")))
    offset = lambda c: F.col(c) - F.col("fid")
    node = nodes.select(line("node", block(""), plain("count"), offset("start_address").cast("string"),
                             offset("end_address").cast("string"), plain("hash"), F.col("insns").cast("string")))
    count = plain("count") if "count" in edges.columns else F.lit("0")
    edge = edges.select(line("edge", block("src_"), block("dst_"), count))
    return funcs.unionByName(node).unionByName(edge)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def heat_report(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per function: names, profile flag, count and ``bid#cold#profiled#count`` of its blocks.

    ``nodes`` has fid, bid, count (null when unknown) and the flags cold and
    has_profile. One line holds one function, as the format asks.
    """
    flag = lambda c: F.col(c).cast("int").cast("string")
    known = F.coalesce("count", F.lit(0)).cast("string")
    block = F.struct("bid", F.concat_ws("#", F.col("bid").cast("string"), flag("cold"), flag("has_profile"), known).alias("t"))
    lists = nodes.groupBy("fid").agg(F.array_sort(F.collect_list(block)).alias("b"))
    names = functions.groupBy("fid").agg(
        F.concat(F.array_join(F.array_sort(F.collect_list("func")), ","), F.lit(",")).alias("names"),
        F.max("count").alias("count"),
    )
    return names.join(lists, "fid", "left").select(
        "fid", "names", (F.col("count") >= 0).alias("has_profile"), F.greatest("count", F.lit(0)).alias("count"),
        F.array_join(F.transform(F.coalesce("b", F.array()), lambda x: x["t"]), " ").alias("blocks"),
    )
