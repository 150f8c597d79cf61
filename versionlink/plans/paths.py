"""Links between the paths of two versions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from versionlink.functions.text import digest, file_name, is_linkable
from versionlink.operators.assign import single_on_both
from versionlink.operators.closest import closest
from versionlink.operators.pairing import block_join
from versionlink.operators.ranks import TASK_ROWS, positions
from versionlink.session import keep, settle

# A (code, occurrence) that forms more path pairs than this is handled by groups of paths.
COMMON_PAIRS = 1_000_000
# Classes of one line that meet in a tile; paths of a class in one row; pairs of paths that a task writes out.
CLASS_TILE = 4_096
CLASS_CHUNK = 256
TASK_PAIRS = 5_000_000


def link_paths_by_name(old_paths: DataFrame, new_paths: DataFrame) -> DataFrame:
    """For each old path, the most similar new path with the same file name.

    Input tables have a ``path`` column. A new path may serve several old ones;
    equally similar paths give the first by name.
    """
    named = lambda side, out: side.select(F.col("path").alias(out), file_name(F.col("path")).alias("file")).distinct()
    best = closest(named(old_paths, "old_path"), named(new_paths, "new_path"), ["file"],
                   "old_path", "new_path", for_right=False)
    return best.groupBy("old_path").agg(F.min("new_path").alias("new_path"))


def replace_with_path(df: DataFrame, column: str, paths: DataFrame) -> DataFrame:
    """Put the linked path in place of ``column`` as ``path``; unlinked values stay."""
    links = link_paths_by_name(df.select(F.col(column).alias("path")).distinct(), paths)
    others = [c for c in df.columns if c != column]
    linked = df.withColumnRenamed(column, "old_path").join(links, "old_path", "left")
    return linked.select(*others, F.coalesce("new_path", "old_path").alias("path"))


def occurrences(src: DataFrame, largest: int | None = None) -> DataFrame:
    """Linkable lines as (path, code, k): the k-th line of the path with that code."""
    lines = src.where(is_linkable(F.col("code"))).select("path", "line", "code")
    return positions(lines, ["path", "code"], ["line"], "k", largest).select("path", "code", "k")


def digested_occurrences(src: DataFrame, largest: int | None = None) -> DataFrame:
    """:func:`occurrences` with the digest of each code in its place, and its length as ``len``."""
    lines = src.where(is_linkable(F.col("code"))).select(
        "path", "line", digest(F.col("code")).alias("code"), F.length("code").alias("len"))
    if largest is None:
        # no group has more lines than its path
        largest = lines.groupBy("path").count().agg(F.max("count")).first()[0] or 0
        largest = largest if largest <= TASK_ROWS else None
    return positions(lines, ["path", "code"], ["line"], "k", largest).select("path", "code", "k", "len")


def shared_line_weight(old_src: DataFrame, new_src: DataFrame) -> DataFrame:
    """Total length of the lines each pair of paths shares, occurrence by occurrence.

    Paths with the same lines in common with the other version form a class; weights are summed
    per pair of classes, and pairs of paths are only written out, not shuffled.
    """
    (old, old_classes), (new, new_classes) = _line_classes(old_src, new_src)

    def chunks(paths: DataFrame, s: str) -> DataFrame:
        # in a struct, since a list of plain values leaves out a null path
        return keep(paths.groupBy(F.col("class").alias(f"{s}_class"), F.pmod(
            F.xxhash64("path"), F.ceil(F.col("n") / CLASS_CHUNK)).alias(f"{s}_chunk")).agg(F.collect_list(F.struct("path")).alias(f"{s}_paths")))

    old_chunks, new_chunks = chunks(old_classes, "old"), chunks(new_classes, "new")
    counted = lambda classes, s: classes.select(F.col("class").alias(f"{s}_class"), F.col("n").alias(f"{s}_n")).distinct()
    weights = keep(_class_weights(old, new).join(counted(old_classes, "old"), "old_class").join(counted(new_classes, "new"), "new_class"))
    total = weights.agg(F.sum(F.col("old_n").cast("double") * F.col("new_n"))).first()[0] or 0.0
    # tasks by the pairs they write out, which Spark cannot see in the bytes it reads
    tasks = max(int(old_src.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_PAIRS))
    met = weights.select("old_class", "new_class", "len").join(old_chunks, "old_class").repartition(tasks, "new_class", "old_chunk")
    spread = new_chunks.join(weights.select("new_class", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("old_n") / CLASS_CHUNK) - 1, F.lit(0)))).alias("old_chunk")).distinct(), "new_class")
    met = met.hint("merge").join(spread.repartition(tasks, "new_class", "old_chunk"), ["new_class", "old_chunk"])
    return met.select(F.explode("old_paths").alias("old"), "new_paths", "len").select(
        "old", F.explode("new_paths").alias("new"), "len").select(F.col("old.path").alias("old_path"), F.col("new.path").alias("new_path"), "len")


def shared_weight_of_two(old_src: DataFrame, new_src: DataFrame) -> DataFrame:
    """As :func:`shared_line_weight`, with two paths standing for each class.

    Paths of one class have equal weights, so where two are open none of them is ever a unique
    best; a third one changes no best and no tie. A path that is null is never won and ties with
    nothing, so it stands beside a single other path.
    """
    (old, old_classes), (new, new_classes) = _line_classes(old_src, new_src)
    whole = (F.count("path") > 1) | (F.count("path") == F.count("*"))
    two = F.array_distinct(F.array(F.min("path"), F.when(whole, F.max("path"))))
    kept = lambda classes, s: classes.groupBy(F.col("class").alias(f"{s}_class")).agg(two.alias("two")).select(
        f"{s}_class", F.explode("two").alias(f"{s}_path"))
    weights = _that_may_be_best(keep(_class_weights(old, new)), old_classes, new_classes)
    return weights.join(kept(old_classes, "old"), "old_class").join(kept(new_classes, "new"), "new_class").select(
        "old_path", "new_path", "len")


def _that_may_be_best(weights: DataFrame, old_classes: DataFrame, new_classes: DataFrame) -> DataFrame:
    """Class pairs without those that are never best for either side, in whatever round.

    Of a class with two paths none is ever won, so what it shares with a class of the other side
    stays open to the end, and nothing less is that class's best.
    """
    def reach(s: str, o: str, classes: DataFrame) -> DataFrame:
        stay = classes.groupBy(F.col("class").alias(f"{o}_class")).agg(F.count("path").alias("n")).where("n > 1").select(f"{o}_class")
        return weights.join(stay, f"{o}_class").groupBy(f"{s}_class").agg(F.max("len").alias(f"{s}_reach"))

    both = weights.join(reach("old", "new", new_classes), "old_class", "left").join(reach("new", "old", old_classes), "new_class", "left")
    least = lambda s: F.col("len") >= F.coalesce(f"{s}_reach", F.col("len"))
    return both.where(least("old") | least("new")).select("old_class", "new_class", "len")


def _line_classes(old_src: DataFrame, new_src: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per version the lines of each class as ``class, key, len``, and its paths as ``class, path, n``."""
    old, new = keep(digested_occurrences(old_src)), keep(digested_occurrences(new_src))
    key = ["code", "k"]
    keys = old.groupBy(*key).agg(F.first("len").alias("len")).join(new.select(*key).distinct(), key)
    # keys and classes are numbered, and the numbers fixed by the checkpoint
    keys = keep(keys.withColumn("key", F.monotonically_increasing_id()))
    sides = []
    for side in (old, new):
        held = keep(side.drop("len").join(keys, key).select("path", "key", "len"))
        named = held.groupBy("path").agg(_set_name(F.xxhash64("key"), F.xxhash64(F.lit("second"), "key")).alias("name"))
        named = settle(named)
        classes = named.groupBy("name").agg(F.min("path").alias("first"), F.count("*").alias("n"))
        classes = settle(classes.withColumn("class", F.monotonically_increasing_id()))
        # a class of the null path alone has no first path
        lines = held.join(classes, held["path"].eqNullSafe(classes["first"])).select("class", "key", "len")
        sides.append((settle(lines), settle(named.join(classes, "name").select("class", "path", "n"))))
    return sides


def _set_name(a: Column, b: Column) -> Column:
    """A name of a set from two hashes of its members: its size and two independent 64-bit sums."""
    return F.struct(F.count("*").alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"), F.bit_xor(b).alias("b"))


def _class_weights(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda lines, s: lines.withColumnRenamed("class", f"{s}_class")
    pairs = block_join(side(old, "old"), side(new, "new").drop("len"), ["key"], CLASS_TILE)
    return pairs.groupBy("old_class", "new_class").agg(F.sum("len").alias("len"))


def link_paths_by_content(old_src: DataFrame, new_src: DataFrame, largest: int | None = None,
                          common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Paths that share the most line text with each other, unique on both sides.

    A line that very many paths hold would form a pair for each two of them.
    Such common lines are compared between groups of paths that hold the same
    set of them. A pair of paths without another shared line then has the weight
    of its groups, which is decided by counting, not by forming the pair.
    """
    old, new = keep(digested_occurrences(old_src, largest)), keep(digested_occurrences(new_src, largest))
    key = ["code", "k"]
    spread = lambda side, out: side.groupBy(*key).agg(F.count("*").alias(out))
    common = (
        spread(old, "a").join(spread(new, "b"), key)
        .where(F.col("a").cast("double") * F.col("b") > common_pairs).select(*key)
    )
    common = settle(common)
    named = lambda side, s: side.withColumnRenamed("path", f"{s}_path")
    if common.isEmpty():
        weights = (
            named(old, "old").join(named(new, "new").drop("len"), key)
            .groupBy("old_path", "new_path").agg(F.sum("len").alias("len"))
        )
        return _unique_best(settle(weights), None, None, None)
    rare = lambda side: side.join(common, key, "left_anti")
    weights = (
        named(rare(old), "old").join(named(rare(new), "new").drop("len"), key)
        .groupBy("old_path", "new_path").agg(F.sum("len").alias("rare"))
    )
    old_group, new_group = _groups(old, common, "old"), _groups(new, common, "new")
    group_weight = settle(_group_weights(old, new, common, old_group, new_group))
    weights = (
        weights.join(old_group, "old_path", "left").join(new_group, "new_path", "left")
        .join(group_weight, ["old_group", "new_group"], "left")
        .select("old_path", "new_path", (F.col("rare") + F.coalesce("common", F.lit(0))).alias("len"))
    )
    return _unique_best(settle(weights), old_group, new_group, group_weight)


def _groups(side: DataFrame, common: DataFrame, s: str) -> DataFrame:
    """Each path's group: the paths that hold the same set of common lines.

    The set is named by its size and two independent 64-bit sums over its
    members, so it needs no list per path.
    """
    held = side.join(common, ["code", "k"])
    name = _set_name(F.xxhash64("code", "k"), F.xxhash64(F.lit("second"), "k", "code"))
    return settle(held.groupBy("path").agg(name.alias(f"{s}_group")).withColumnRenamed("path", f"{s}_path"))


def _group_weights(old: DataFrame, new: DataFrame, common: DataFrame,
                   old_group: DataFrame, new_group: DataFrame) -> DataFrame:
    def members(side: DataFrame, groups: DataFrame, s: str) -> DataFrame:
        one = groups.groupBy(f"{s}_group").agg(F.min(f"{s}_path").alias("path"))
        return side.join(one, "path").join(common, ["code", "k"]).select(f"{s}_group", "code", "k", "len")

    pairs = members(old, old_group, "old").join(members(new, new_group, "new").drop("len"), ["code", "k"])
    return pairs.groupBy("old_group", "new_group").agg(F.sum("len").alias("common"))


def _unique_best(weights: DataFrame, old_group, new_group, group_weight) -> DataFrame:
    """Mutual best, unique pairs of ``weights`` and of the pairs that only groups stand for."""
    best = lambda s: weights.groupBy(f"{s}_path").agg(F.max("len").alias(f"{s}_best"))
    old_best, new_best = best("old"), best("new")
    if group_weight is not None:
        def widened(own: DataFrame, groups: DataFrame, s: str) -> DataFrame:
            reach = group_weight.groupBy(f"{s}_group").agg(F.max("common").alias("reach"))
            both = groups.join(reach, f"{s}_group").join(own, f"{s}_path", "full")
            return both.select(
                f"{s}_path", f"{s}_group", F.greatest("reach", f"{s}_best").alias(f"{s}_best")
            )

        old_best = settle(widened(old_best, old_group, "old"))
        new_best = settle(widened(new_best, new_group, "new"))
    won = weights.join(old_best, "old_path").join(new_best, "new_path").where("len = old_best and len = new_best")
    won = settle(won.select("old_path", "new_path", "len"))
    if group_weight is None:
        return single_on_both(won, ["old_path"], ["new_path"])

    # classes: paths of one group with one best weight; a class pair ties when both bests are its weight
    def classes(top: DataFrame, s: str) -> DataFrame:
        return top.where(F.col(f"{s}_group").isNotNull()).groupBy(
            f"{s}_group", F.col(f"{s}_best").alias("common")
        ).agg(F.count("*").alias(f"{s}_n"), F.min(f"{s}_path").alias(f"{s}_path"))

    tied = settle(
        group_weight.join(classes(old_best, "old"), ["old_group", "common"])
        .join(classes(new_best, "new"), ["new_group", "common"])
    )
    # partners each path has through its class
    partners = lambda s, other: tied.groupBy(f"{s}_group", F.col("common").alias(f"{s}_best")).agg(
        F.sum(f"{other}_n").alias("partners")
    )
    def taken(s: str, other: str, top: DataFrame) -> DataFrame:
        listed = won.select(f"{s}_path").withColumn("partners", F.lit(1))
        through = top.join(partners(s, other), [f"{s}_group", f"{s}_best"]).select(f"{s}_path", "partners")
        return listed.unionByName(through).groupBy(f"{s}_path").agg(F.sum("partners").alias("n")).where(
            "n = 1"
        ).select(f"{s}_path")

    pairs = won.unionByName(
        tied.where("old_n = 1 and new_n = 1").select("old_path", "new_path", F.col("common").alias("len"))
    )
    return (
        pairs.join(taken("old", "new", old_best), "old_path", "left_semi")
        .join(taken("new", "old", new_best), "new_path", "left_semi")
        .select("old_path", "new_path", "len")
    )
