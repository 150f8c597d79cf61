"""Links between basic blocks, by hash, by item scores and by votes of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from versionlink.operators.assign import Tier, retire, unique_mutual_best
from versionlink.plans.items import SCORES
from versionlink.session import compact, keep, settle, union_all

OLD, NEW = ["old_fid", "old_bid"], ["new_fid", "new_bid"]
BLOCKS = [*OLD, *NEW]


def block_scores(ins_map: DataFrame) -> DataFrame:
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)), 6).alias(c)
    return ins_map.groupBy(*BLOCKS).agg(*[total(c) for c in SCORES])


def link_blocks_by_hash(func_map: DataFrame, old_node: DataFrame, new_node: DataFrame) -> DataFrame:
    """Blocks of linked functions with the same hash, unique on both sides.

    Partners are counted per (function, hash), so a repeated hash forms no pairs.
    """
    links = func_map.select("old_fid", "new_fid").distinct()

    def only_partner(own: DataFrame, other: DataFrame, s: str, o: str) -> DataFrame:
        blocks = own.select(F.col("fid").alias(f"{s}_fid"), F.col("bid").alias(f"{s}_bid"), "hash").distinct()
        groups = other.select(F.col("fid").alias(f"{o}_fid"), "bid", "hash").distinct().groupBy(f"{o}_fid", "hash").agg(
            F.count("*").alias("n"), F.min("bid").alias(f"{o}_bid")
        )
        partners = blocks.join(links, f"{s}_fid").join(groups, [f"{o}_fid", "hash"])
        return partners.groupBy(f"{s}_fid", f"{s}_bid").agg(
            F.sum("n").alias("n"), F.min(f"{o}_fid").alias(f"{o}_fid"), F.min(f"{o}_bid").alias(f"{o}_bid")
        ).where("n = 1").select(*BLOCKS)

    return only_partner(old_node, new_node, "old", "new").join(
        only_partner(new_node, old_node, "new", "old"), BLOCKS
    )


def _edges(edge: DataFrame, s: str, via: str, to: str) -> DataFrame:
    """Edges of a side with the number of parallel ones."""
    ends = [F.col(f"{to}_fid").alias(f"{s}_fid"), F.col(f"{to}_bid").alias(f"{s}_bid"),
            F.col(f"{via}_fid").alias(f"{s}_via_fid"), F.col(f"{via}_bid").alias(f"{s}_via_bid")]
    return edge.groupBy(*ends).agg(F.count("*").alias(f"{s}_n"))


def _via(bb_map: DataFrame) -> DataFrame:
    return bb_map.select(*[F.col(f"{s}_{c}").alias(f"{s}_via_{c}") for s in ("old", "new") for c in ("fid", "bid")])


def neighbour_votes(pairs: DataFrame, bb_map: DataFrame, old_edge: DataFrame, new_edge: DataFrame,
                    via: str, to: str) -> DataFrame:
    """Votes for candidate pairs: linked blocks with an edge from ``via`` to ``to`` on both sides.

    Parallel edges count each; they are counted before the joins. Starting from
    the candidates, every join has both ends of an edge or a one-to-one link.
    """
    votes = (
        pairs.select(*BLOCKS).join(_edges(old_edge, "old", via, to), OLD)
        .join(_via(bb_map), ["old_via_fid", "old_via_bid"])
        .join(_edges(new_edge, "new", via, to), [*NEW, "new_via_fid", "new_via_bid"])
    )
    return votes.groupBy(*BLOCKS).agg(F.sum(F.col("old_n") * F.col("new_n")).alias("votes"))


def votes_beside_links(func_map: DataFrame, bb_map: DataFrame, old_edge: DataFrame, new_edge: DataFrame,
                       via: str, to: str) -> DataFrame:
    """:func:`neighbour_votes` for all open pairs of blocks of linked functions.

    Only neighbours of links have votes, so the pairs come from the links and their edges;
    the candidates are never formed.
    """
    pairs = (
        _via(bb_map).join(_edges(old_edge, "old", via, to), ["old_via_fid", "old_via_bid"])
        .join(_edges(new_edge, "new", via, to), ["new_via_fid", "new_via_bid"])
    )
    votes = pairs.groupBy(*BLOCKS).agg(F.sum(F.col("old_n") * F.col("new_n")).alias("votes"))
    votes = votes.join(func_map.select("old_fid", "new_fid").distinct(), ["old_fid", "new_fid"], "left_semi")
    return retire(votes, bb_map, OLD, NEW).select(*BLOCKS, "votes")


def link_blocks(old_node: DataFrame, new_node: DataFrame, old_edge: DataFrame, new_edge: DataFrame,
                ins_map: DataFrame, func_map: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All block links.

    After the hash links, each round takes the first of: item scores (jump and
    opcode); successor votes and then predecessor votes on what those left; both
    votes together; all four item scores. It ends when none gives a link.
    """
    seed = keep(link_blocks_by_hash(func_map, old_node, new_node))
    rest = keep(retire(block_scores(ins_map), seed, OLD, NEW))
    found, rounds = [seed], 0

    def take(pairs: DataFrame, *scores: str) -> bool:
        nonlocal rest, found
        won = settle(unique_mutual_best(pairs, OLD, NEW, [Tier(s) for s in scores]).select(*BLOCKS))
        if won.isEmpty():
            return False
        found = compact([*found, won])
        rest = settle(retire(rest, won, OLD, NEW))
        return True

    def votes(via: str, to: str) -> DataFrame:
        return settle(neighbour_votes(rest, union_all(found), old_edge, new_edge, via, to))

    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        if rest.isEmpty():
            break
        if take(rest, *SCORES[:2]):
            continue
        after = votes("src", "dst")
        grown = take(after, "votes")
        before = votes("dst", "src")
        if take(before, "votes") or grown:
            continue
        both = after.unionByName(before).groupBy(*BLOCKS).agg(F.sum("votes").alias("votes"))
        if take(settle(both), "votes"):
            continue
        if not take(rest, *SCORES):
            break
    return union_all(found)
