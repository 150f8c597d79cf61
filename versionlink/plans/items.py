"""Links between the instructions of linked lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from versionlink.functions.similarity import edit_similarity, offset_closeness
from versionlink.functions.text import jump_name, jump_offset, opcode, operand
from versionlink.operators.assign import Tier, mutual_best, retire
from versionlink.operators.closest import closest
from versionlink.operators.ranks import average_rank
from versionlink.session import keep, settle, union_all

OLD_ITEM, NEW_ITEM = ["old_fid", "old_bid", "old_index"], ["new_fid", "new_bid", "new_index"]
SCORES = ["jump_func_score", "opcode_match_score", "jump_diff_score", "operand_match_score"]


def split_items(ins: DataFrame) -> DataFrame:
    """Opcode and operand of each instruction; the address orders the items."""
    return ins.select(
        "fid", "path", "line", "bid", F.col("address").alias("index"),
        opcode(F.col("instruction")).alias("opcode"), operand(F.col("instruction")).alias("operand"),
    ).distinct()


def item_candidates(old_ins: DataFrame, new_ins: DataFrame, fsrc_map: DataFrame) -> DataFrame:
    """Items of linked lines with the same first opcode letter whose opcodes are
    most similar for either side, with four scores.

    Opcodes are compared as the distinct values of a line pair of two functions.
    """
    letter = lambda s: F.substring(f"{s}_opcode", 1, 1).alias("oid")
    side = lambda ins, s: split_items(ins).select(
        *[F.col(c).alias(f"{s}_{c}") for c in ("fid", "path", "line", "bid", "index", "opcode", "operand")]
    ).select("*", letter(s))
    old, new = keep(side(old_ins, "old")), keep(side(new_ins, "new"))
    place = lambda s: [f"{s}_fid", f"{s}_path", f"{s}_line"]
    # links are numbered, and the numbers fixed by the kept table, so that rows need not carry both places
    links = fsrc_map.groupBy(*place("old"), *place("new")).agg(F.count("*").alias("times"))
    links = keep(links.withColumn("link", F.monotonically_increasing_id()))
    # the best partner of an item may be in any function its own is linked with
    group = lambda *key: F.min("link").over(Window.partitionBy(*key))
    groups = links.select("link", group(*place("old"), "new_path", "new_line").alias("old_group"),
                          group(*place("new"), "old_path", "old_line").alias("new_group"))

    def linked(items: DataFrame, s: str) -> DataFrame:
        rows = items.join(links.select(*place(s), "link"), place(s))
        return keep(rows.select("link", "oid", *[f"{s}_{c}" for c in ("fid", "bid", "index", "opcode", "operand")]))

    old, new = linked(old, "old"), linked(new, "new")
    block = ["link", "oid"]
    near = closest(old.select(*block, "old_opcode"), new.select(*block, "new_opcode"), block, "old_opcode", "new_opcode")
    near = keep(near.withColumn("opcode_match_score", F.round("similarity", 10)).drop("similarity").join(groups, "link"))
    top = lambda key, flag, out: near.where(flag).groupBy(*key).agg(F.max("opcode_match_score").alias(out))
    old_key, new_key = ["old_group", "oid", "old_opcode"], ["new_group", "oid", "new_opcode"]
    near = keep(
        near.join(top(old_key, "best_left", "__l"), old_key, "left")
        .join(top(new_key, "best_right", "__r"), new_key, "left")
        .where("(best_left and opcode_match_score = __l) or (best_right and opcode_match_score = __r)")
        .select(*block, "old_opcode", "new_opcode", "opcode_match_score")
    )
    pairs = old.join(near, [*block, "old_opcode"]).join(new, [*block, "new_opcode"])
    repeated = links.where("times > 1").select("link", F.sequence(F.lit(2), F.col("times")).alias("again"))
    if not repeated.isEmpty():
        # a link that comes twice gives its pairs twice
        pairs = pairs.unionByName(pairs.join(repeated, "link").withColumn("again", F.explode("again")).drop("again"))
    jump = lambda f, s: f(F.col("oid"), F.col(f"{s}_operand"))
    jump_score = F.round(edit_similarity(jump(jump_name, "old"), jump(jump_name, "new")), 10)
    return pairs.select(
        *OLD_ITEM, *NEW_ITEM,
        (jump_score + F.col("opcode_match_score")).alias("jump_func_score"), "opcode_match_score",
        offset_closeness(jump(jump_offset, "old"), jump(jump_offset, "new")).alias("jump_diff_score"),
        F.round(edit_similarity("old_operand", "new_operand"), 10).alias("operand_match_score"),
    )


def link_items(candidates: DataFrame, jumps_only: bool = True, max_rounds: int | None = None) -> DataFrame:
    """Link items in rounds; an item may link into several blocks in one round.

    Each score is best for the old item within the new block and for the new
    item within the old block, tier by tier; what still ties is linked k-th with
    k-th. A missing jump score fails the first tier; ``jumps_only=False`` lets
    rows pass whose group has no jump score at all.
    """
    left, right = [*OLD_ITEM, "new_fid", "new_bid"], [*NEW_ITEM, "old_fid", "old_bid"]
    tiers = [
        Tier("jump_func_score", null_safe=not jumps_only), Tier("opcode_match_score"),
        Tier("jump_diff_score", null_safe=True), Tier("operand_match_score"),
    ]
    rest = candidates.where("jump_func_score is not null") if jumps_only else candidates
    rest = keep(rest)
    parts: list[DataFrame] = []
    while max_rounds is None or len(parts) < max_rounds:
        tied = mutual_best(rest, left, right, tiers)
        tied = tied.withColumn("__new_rank", average_rank("new_index", left)).withColumn(
            "__old_rank", average_rank("old_index", right)
        )
        won = settle(tied.where("__new_rank = __old_rank").select(*rest.columns))
        if won.isEmpty():
            break
        parts.append(won)
        rest = keep(retire(rest, won, OLD_ITEM, NEW_ITEM))
    return union_all(parts) if parts else candidates.limit(0)
