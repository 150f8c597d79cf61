"""Carry the counts of the old version over to the new one along the links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from versionlink.functions.similarity import call_distance, name_distance
from versionlink.operators.assign import retire
from versionlink.operators.ordered import rounds_of_ordered_best
from versionlink.session import settle, union_all

TOMBSTONE = -1


def project_counts(counts: DataFrame, explicit: DataFrame, weaker: list[DataFrame], size: DataFrame,
                   unique: bool = False) -> DataFrame:
    """Counts of old blocks on the new blocks they are linked to.

    ``counts``: old_fid, old_bid, count; ``explicit`` and each of ``weaker`` (by
    falling precedence): old_fid, old_bid, new_fid, new_bid; ``size``: new_fid,
    blocks. A target is taken once, by the first rule and the first old block.
    Blocks with an explicit link, also to the tombstone, are barred from weaker
    rules. Targets past the end are skipped. With ``unique`` a source is used once
    too: links are taken in the order of rule, source and target, each if both its
    ends are still free. A link that comes first at both ends is taken in any case, so
    rounds of those give the same.
    """
    source, target = ["old_fid", "old_bid"], ["new_fid", "new_bid"]
    ranked = explicit.withColumn("rule", F.lit(0))
    for i, links in enumerate(weaker, start=1):
        open_links = links.join(explicit.select(*source), source, "left_anti")
        ranked = ranked.unionByName(open_links.withColumn("rule", F.lit(i)))
    ranked = ranked.join(size, "new_fid").where((F.col("new_bid") != TOMBSTONE) & (F.col("new_bid") < F.col("blocks")))
    ranked = ranked.drop("blocks")
    first = lambda links, end, other: links.groupBy(*end).agg(F.min(F.struct("rule", *other)).alias("f")).select(*end, "f.*")
    if not unique:
        return first(ranked, target, source).join(counts, source).select(*source, *target, "rule", "count")
    parts, open_links = [], settle(ranked.select("rule", *source, *target).distinct())
    while not open_links.isEmpty():
        won = settle(first(open_links, target, source).join(first(open_links, source, target), ["rule", *source, *target]))
        parts.append(won)
        open_links = settle(retire(open_links, won, source, target))
    taken = union_all(parts) if parts else open_links
    return taken.join(counts, source).select(*source, *target, "rule", "count")


def cross_projection(edges: DataFrame, cross: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights from blocks linked into other functions.

    ``edges``: old_fid, src_bid, dst_bid, count, at (file order); ``cross``:
    new_fid, new_bid, old_fid, old_bid. Returns edge weights (both ends linked,
    edge present, last one wins) and block in/out weights (these add up).
    Edges without a count are skipped.
    """
    edges = edges.where(F.col("count") != 0)
    end = lambda e: cross.select(
        "old_fid", F.col("old_bid").alias(f"{e}_bid"), "new_fid", F.col("new_bid").alias(f"new_{e}")
    )
    key = ["old_fid", "new_fid"]
    out = edges.join(end("src"), ["old_fid", "src_bid"])
    into = edges.join(end("dst"), ["old_fid", "dst_bid"])
    both = out.join(end("dst"), [*key, "dst_bid"]).join(
        new_edges.select("new_fid", "new_src", "new_dst").distinct(), ["new_fid", "new_src", "new_dst"]
    )
    last = F.max_by("count", F.struct("old_fid", "at"))
    weights = both.groupBy("new_fid", "new_src", "new_dst").agg(last.alias("weight"))
    sums = out.groupBy("new_fid", F.col("new_src").alias("new_bid")).agg(
        F.sum("count").alias("out_weight"), F.lit(0).cast("bigint").alias("in_weight")
    ).unionByName(into.groupBy("new_fid", F.col("new_dst").alias("new_bid")).agg(
        F.lit(0).cast("bigint").alias("out_weight"), F.sum("count").alias("in_weight")
    ))
    totals = sums.groupBy("new_fid", "new_bid").agg(
        F.sum("out_weight").alias("out_weight"), F.sum("in_weight").alias("in_weight")
    )
    return weights, totals


def resolve_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Old names replaced by their mapped name (``old_func, new_func``) before lookup."""
    links = aliases.select(F.col("old_func").alias("func"), F.col("new_func").alias("__to"))
    return names.join(links, "func", "left").select(
        *[c for c in names.columns if c != "func"], "func", F.coalesce("__to", "func").alias("lookup")
    )


def nearest_calls_in_file(old: DataFrame, new: DataFrame, block: str = "file", same_size: bool = False,
                          max_rounds: int | None = None) -> DataFrame:
    """One-to-one links by call-name distance inside a file block, nearest first.

    Tables have ``fid, func, blocks`` and the block column. With ``same_size``
    only functions of the same number of blocks meet. Equally near pairs go by
    their names (last first), so the order is total.
    """
    keys = [block, "blocks"] if same_size else [block]
    def score(a, b) -> Column:
        near = call_distance(a("name"), b("name"))
        return F.struct((-near["distance"]).alias("distance"), (-near["tie"]).alias("tie"), a("name").alias("a"), b("name").alias("b"))

    named = lambda side: side.withColumn("name", F.col("func"))
    return rounds_of_ordered_best(named(old), named(new), keys, ["name"], score, None, True, max_rounds)


def nearest_parts_in_file(old: DataFrame, new: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """One-to-one links by (name, parameters, suffix) distance inside a file stem, nearest first.

    Tables have ``fid, func, namespace, basename, parameters, extension, stem``;
    alias rows of a function compete with their own distance.
    """
    def score(a, b) -> Column:
        near = name_distance(a("namespace"), b("namespace"), a("basename"), b("basename"),
                             a("parameters"), b("parameters"), a("extension"), b("extension"))
        return F.struct(*[(-near[c]).alias(c) for c in ("name", "params", "suffix")], a("func").alias("a"), b("func").alias("b"))

    return rounds_of_ordered_best(
        old, new, ["stem"], ["func", "namespace", "basename", "parameters", "extension"], score, None, True, max_rounds
    )


def nearest_name(old: DataFrame, new: DataFrame, block: list[str]) -> DataFrame:
    """Each old name's nearest new name of its block, ties by name (not one to one)."""
    pairs = old.select(*block, F.col("func").alias("old_func")).join(
        new.select(*block, F.col("func").alias("new_func")), block
    )
    near = F.struct(call_distance("old_func", "new_func").alias("near"), F.col("new_func"))
    return pairs.groupBy("old_func").agg(F.min(near).alias("best")).select("old_func", "best.new_func", "best.near.distance")


def sample_shares(counts: DataFrame) -> DataFrame:
    """Samples by state: stale, inferred, total and the percentage of both states.

    ``counts`` has ``count`` and the flags ``stale`` and ``inferred``.
    """
    of = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("count"))), F.lit(0))
    sums = counts.agg(of("stale").alias("stale"), of("inferred").alias("inferred"), F.sum("count").alias("total"))
    return sums.withColumn("percent", F.round(100.0 * (F.col("stale") + F.col("inferred")) / F.col("total"), 1))


def fall_through_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source block ends where the target block starts.

    ``edges``: src_fid, src_bid, dst_fid, dst_bid, count; ``nodes``: fid, bid,
    start_address, end_address.
    """
    end = nodes.select(F.col("fid").alias("src_fid"), F.col("bid").alias("src_bid"), F.col("end_address").alias("__end"))
    start = nodes.select(F.col("fid").alias("dst_fid"), F.col("bid").alias("dst_bid"), F.col("start_address").alias("__start"))
    return (
        edges.join(end, ["src_fid", "src_bid"]).join(start, ["dst_fid", "dst_bid"])
        .where("__end = __start").drop("__end", "__start").select(*edges.columns)
    )


def fall_through_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return fall_through_edges(edges, nodes).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("score"))


def link_methods(links_by_method: dict[str, DataFrame]) -> DataFrame:
    """One link table with the method that made each link; earlier methods win."""
    whole = None
    for order, (method, links) in enumerate(links_by_method.items()):
        part = links.select("old_fid", "new_fid", F.lit(method).alias("method"), F.lit(order).alias("__order"))
        whole = part if whole is None else whole.unionByName(part)
    first = F.min(F.struct("__order", "method", "new_fid")).alias("f")
    return whole.groupBy("old_fid").agg(first).select("old_fid", "f.new_fid", "f.method")
