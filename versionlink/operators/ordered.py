"""One-to-one assignment by a composite score, with name order for ties.

Rows with the same block and the same compared values form a *class*. Scores
are computed once per pair of classes, not per pair of rows, so copies cost
nothing; rows only meet their own class.

Where a ``fid`` has one row, blocks do not touch each other. Blocks of up to ``IN_TASK`` class pairs
(and ``ROWS_IN_TASK`` rows) then run all their rounds in one task, many small blocks to a task; larger
ones go by rounds of joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from versionlink.operators.assign import retire
from versionlink.operators.pairing import block_join
from versionlink.operators.ranks import positions
from versionlink.session import empty_like, settle, union_all

Field = Callable[[str], Column]

# Class pairs and rows of a block that one task may link.
IN_TASK = 1_000_000
ROWS_IN_TASK = 500_000
# Class pairs, and ten times the rows, that a task's blocks have together, about.
TASK_WORK = 200_000
# Classes of a side that meet in one tile when a task scores about TASK_WORK pairs.
TILE_CLASSES = 400
# Pairs of letters of compared texts that a task scores, about; scores by edit distance take that much work.
TASK_LETTERS = 500_000_000
# Pairs of letters of a class pair, in the mean, from which texts count as long.
LONG_PAIR = 4_000
# Class pairs from which a block is a matrix.
MATRIX = 4_000
_LINK = "old_fid long, old_func string, new_fid long, new_func string"


def _classes(rows: DataFrame, block: list[str], compared: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(classes, rows): the distinct compared values under a short id, and each row with its class."""
    values = list(dict.fromkeys([*block, *compared]))
    # the ids are fixed by the checkpoint
    letters = sum((F.coalesce(F.length(F.col(c)), F.lit(0)) for c in compared if rows.schema[c].dataType == StringType()), F.lit(1))
    classes = rows.groupBy(*values).agg(F.count("*").alias("__copies")).withColumn("__letters", letters)
    classes = settle(classes.withColumn(name, F.monotonically_increasing_id()))
    named = classes.drop("__copies", "__letters").withColumnsRenamed({v: f"__of_{v}" for v in values})
    same = [F.col(v).eqNullSafe(F.col(f"__of_{v}")) for v in values]
    return classes, rows.join(named, same).select("fid", "func", name)


@dataclass(frozen=True)
class Work:
    """Class pairs, and the pairs of letters of their texts that scores may compare."""

    pairs: float
    letters: float

    @property
    def tasks(self) -> int:
        return 1 + int(self.pairs) // TASK_WORK + int(self.letters) // TASK_LETTERS

    @property
    def tile_classes(self) -> int:
        """Classes of a side in a tile: several tiles of pairs of mean length make the work of a task."""
        return max(1, min(TILE_CLASSES, math.isqrt(int(TASK_LETTERS / 4 * self.pairs / self.letters)))) if self.letters else TILE_CLASSES


def class_pairs(old: DataFrame, new: DataFrame, block: list[str], compared: list[str],
                score: Callable[[Field, Field], Column],
                keep: Callable[[Field, Field], Column] | None = None, work: Work | None = None) -> DataFrame:
    """(old_class, new_class, score) for every pair of classes of one block, in tasks by their ``work``."""
    values = list(dict.fromkeys([*block, *compared]))
    pack = lambda side, name, out: side.select(*block, name, F.struct(*values).alias(out))
    sides = pack(old, "old_class", "__a"), pack(new, "new_class", "__b")
    pairs = block_join(*sides, block) if work is None else block_join(*sides, block, work.tile_classes, work.tasks)
    a: Field = lambda name: F.col("__a")[name]
    b: Field = lambda name: F.col("__b")[name]
    if keep is not None:
        pairs = pairs.where(keep(a, b))
    return pairs.select("old_class", "new_class", score(a, b).alias("score"))


def rounds_of_ordered_best(old: DataFrame, new: DataFrame, block: list[str], compared: list[str],
                           score: Callable[[Field, Field], Column],
                           keep: Callable[[Field, Field], Column] | None = None,
                           aliases: bool = True, max_rounds: int | None = None,
                           stored_pairs: int = 2_000_000_000, in_task: int | None = None,
                           long_score: Callable[[Field, Field], Column] | None = None) -> DataFrame:
    """Link ``fid``s one to one by the largest ``score`` inside ``block``.

    In each round a pair must be best for both fids; an old fid takes its first
    such partner by (old_func, new_func), then a new fid its first taker.
    Partners retire and the round repeats until no pair is open. Where every
    class of one set ties with every class of another, that rule gives one pair
    per round in name order, k-th with k-th. When no class of such sets has an open
    pair outside, all their pairs are taken at once. Other such sets advance
    together by as many rounds as pass until the first of their classes runs out,
    for until then nothing that the rule looks at can change.

    A fid may have several rows (``aliases``). Class pairs are stored once when
    there are up to ``stored_pairs`` of them; beyond that they are formed again
    in each round from the classes still open, so nothing quadratic is kept.
    ``in_task`` (default ``IN_TASK``) bounds the blocks that are linked in one task. ``long_score`` gives the
    same scores as ``score`` and is taken where the compared texts are long.
    """
    most = IN_TASK if in_task is None else in_task
    old_classes, old_rows = _classes(old, block, compared, "old_class")
    new_classes, new_rows = _classes(new, block, compared, "new_class")
    blocks = _blocks(old_classes, new_classes, block)
    whole, small, small_rows = _pair_count(blocks, most)
    pair_count, small_count = whole.pairs, small.pairs
    if long_score is not None and whole.letters > LONG_PAIR * pair_count:
        score = long_score
    if not pair_count:
        return _result(old)
    aliases = aliases and (_several(old) or _several(new))
    if small_count and not aliases and max_rounds is None:
        sides = (old_classes, old_rows, new_classes, new_rows)
        if small_count == pair_count:
            return settle(_linked_in_tasks(*sides, block, compared, score, keep, small, small_rows))
        few = settle(blocks.where(_small(most)).select(*block))
        part = lambda rows, how: rows.join(few, block, how).select(*rows.columns)
        of = lambda rows, name, classes: rows.join(part(classes, "left_semi").select(name), name, "left_semi")
        sides = (part(old_classes, "left_semi"), of(old_rows, "old_class", old_classes),
                 part(new_classes, "left_semi"), of(new_rows, "new_class", new_classes))
        won = _linked_in_tasks(*sides, block, compared, score, keep, small, small_rows)
        rest = rounds_of_ordered_best(part(old, "left_anti"), part(new, "left_anti"), block, compared, score, keep,
                                      aliases, max_rounds, stored_pairs, 0, long_score)
        return settle(won.unionByName(rest))
    old_rows, new_rows = settle(old_rows), settle(new_rows)

    def score_all(live_old: DataFrame, live_new: DataFrame) -> DataFrame:
        return class_pairs(
            old_classes.join(live_old.select("old_class"), "old_class", "left_semi"),
            new_classes.join(live_new.select("new_class"), "new_class", "left_semi"),
            block, compared, score, keep, whole,
        )

    pairs = None
    if pair_count <= stored_pairs:
        pairs = settle(class_pairs(old_classes, new_classes, block, compared, score, keep, whole))

    won_parts: list[DataFrame] = []
    while max_rounds is None or len(won_parts) < max_rounds:
        live_old, live_new = old_rows, new_rows
        if won_parts:
            won = union_all(won_parts)
            live_old = retire(old_rows, won.select(F.col("old_fid").alias("fid")), ["fid"])
            live_new = retire(new_rows, won.select(F.col("new_fid").alias("fid")), ["fid"])
        if pairs is None:
            live_pairs = score_all(live_old, live_new)
        else:
            live_pairs = (
                pairs.join(live_old.select("old_class"), "old_class", "left_semi")
                .join(live_new.select("new_class"), "new_class", "left_semi")
                if won_parts else pairs
            )
        active_old = _active(live_old, live_pairs, "old_class", aliases)
        active_new = _active(live_new, live_pairs, "new_class", aliases)
        mutual = settle(_mutual(live_pairs, active_old, active_new))
        if mutual.isEmpty():
            break
        ties = settle(_ties(mutual))
        bulk, single, bound, largest = ties.agg(
            F.sum(F.col("bulk").cast("int")), F.sum((~F.col("bulk")).cast("int")),
            F.sum((F.col("bulk") & ~F.col("alone")).cast("int")),
            F.max(F.greatest(F.col("old_n") * F.col("takers.n"), F.col("new_n") * F.col("picks.n"))),
        ).first()
        parts = []
        if single:
            parts.append(_first_takers(ties.where(~F.col("bulk")), active_old, aliases))
        if bulk:
            parts.append(_kth_with_kth(ties.where("bulk"), active_old, active_new, largest, bool(bound), bool(single)))
        won_parts.append(settle(union_all(parts)))
    return union_all(won_parts) if won_parts else _result(old)


def _result(old: DataFrame) -> DataFrame:
    named = old.select(
        F.col("fid").alias("old_fid"), F.col("func").alias("old_func"),
        F.col("fid").alias("new_fid"), F.col("func").alias("new_func"),
    )
    return empty_like(named)


def _blocks(old_classes: DataFrame, new_classes: DataFrame, block: list[str]) -> DataFrame:
    """The blocks of both sides with their classes and rows on each."""
    sizes = lambda side, name: side.groupBy(*block).agg(
        F.count("*").cast("double").alias(name), F.sum("__copies").cast("double").alias(f"{name}_rows"),
        F.sum("__letters").cast("double").alias(f"{name}_letters"))
    return sizes(old_classes, "__a").join(sizes(new_classes, "__b"), block)


def _small(most: int) -> Column:
    return (F.col("__a") * F.col("__b") <= most) & (F.col("__a_rows") + F.col("__b_rows") <= ROWS_IN_TASK)


def _pair_count(blocks: DataFrame, most: int) -> tuple[Work, Work, float]:
    """Class pairs before ``keep`` and their letters, of all blocks and of the small ones; rows of the small ones."""
    total = lambda which, what: F.coalesce(F.sum(F.when(which, what)), F.lit(0.0))
    pairs, letters = F.col("__a") * F.col("__b"), F.col("__a_letters") * F.col("__b_letters")
    small, rows = _small(most), F.col("__a_rows") + F.col("__b_rows")
    found = blocks.agg(*[total(which, what) for which in (F.lit(True), small) for what in (pairs, letters)], total(small, rows)).first()
    return Work(*found[:2]), Work(*found[2:4]), found[4]


def _several(rows: DataFrame) -> bool:
    """Whether some fid has several rows."""
    return not rows.groupBy("fid").count().where("count > 1").isEmpty()


def _linked_in_tasks(old_classes: DataFrame, old_rows: DataFrame, new_classes: DataFrame, new_rows: DataFrame, block: list[str],
                     compared: list[str], score: Callable[[Field, Field], Column], keep, work: Work, row_count: float) -> DataFrame:
    """All rounds of small blocks: scores are made per pair of classes as ever, a bucket of blocks goes through its rounds in a task."""
    tasks = 1 + int(work.pairs + 10 * row_count) // TASK_WORK
    pairs = class_pairs(old_classes, new_classes, block, compared, score, keep, work)
    key = F.xxhash64(*block).alias("block")  # two blocks under one key do not disturb each other
    of = lambda classes, name: classes.select(name, key)
    none = F.lit(None)
    parts = [pairs.join(of(old_classes, "old_class"), "old_class").select(
        "block", F.lit(0).alias("kind"), F.col("old_class").alias("a"), F.col("new_class").alias("b"), "score", none.cast("string").alias("func"))]
    for kind, (rows, classes, name) in enumerate(((old_rows, old_classes, "old_class"), (new_rows, new_classes, "new_class")), 1):
        parts.append(rows.join(of(classes, name), name).select(
            "block", F.lit(kind).alias("kind"), F.col("fid").cast("long").alias("a"), F.col(name).alias("b"),
            none.cast(pairs.schema["score"].dataType).alias("score"), "func"))
    table = union_all(parts).withColumn("bucket", F.pmod("block", F.lit(tasks))).repartition(tasks, "bucket")
    return table.groupBy("bucket").applyInArrow(_bucket_links, _LINK)


def _bucket_links(table: pa.Table) -> pa.Table:
    table = table.select(["block", "kind", "a", "b", "score", "func"]).combine_chunks()
    kind = table["kind"].to_numpy()
    pairs, sides = table.filter(pa.array(kind == 0)), [table.filter(pa.array(kind == k)) for k in (1, 2)]
    rows: list[dict] = [{}, {}]
    for side, own in zip(sides, rows):
        for at, fid, name, func in zip(*(side[c].to_pylist() for c in ("block", "a", "b", "func"))):
            # nulls first, as Spark orders them
            own.setdefault(at, {}).setdefault(name, []).append(((func is not None, func or ""), fid))
    at, a, b = (pairs[c].to_numpy() for c in ("block", "a", "b"))
    order = np.argsort(at, kind="stable")
    at, a, b, rank = at[order], a[order], b[order], _ranks(pairs["score"])[order]
    ends = np.flatnonzero(np.diff(at)) + 1
    links = []
    for one in np.split(np.arange(len(at)), ends) if len(at) else []:
        first, last = one[0], one[-1] + 1
        old, new = (own[at[first].item()] for own in rows)
        own = a[first:last], b[first:last], rank[first:last]
        if len(one) < MATRIX:
            x, y, value = (c.tolist() for c in own)
            links += _block_links(dict(zip(zip(x, y), value)), old, new)
        else:
            links += _matrix_links(*own, old, new)
    text = lambda named: named[1] if named[0] else None
    columns = list(zip(*((old, text(a), new, text(b)) for old, a, new, b in links))) or [()] * 4
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["old_fid", "old_func", "new_fid", "new_func"])


def _ranks(scores: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the scores, field by field; nulls first, as Spark orders them."""
    rank = np.zeros(len(scores), np.int64)
    for field in pa.Table.from_struct_array(scores).columns if len(scores) else []:
        known = field.is_valid().to_numpy()
        place = np.zeros(len(rank), np.int64)
        place[known] = 1 + np.unique(field.drop_null().to_numpy(), return_inverse=True)[1]
        rank = np.unique(rank * (place.max() + 1) + place, return_inverse=True)[1]
    return rank


def _block_links(pairs: dict, old: dict, new: dict) -> Iterable[tuple]:
    """The rounds of one block. ``pairs``: score by classes; ``old``, ``new``: (func, fid) of each class."""
    for side in (old, new):
        for rows in side.values():
            rows.sort(reverse=True)  # the first row is the last of the list
    while pairs:
        best_old, best_new = {}, {}
        for (a, b), value in pairs.items():
            if a not in best_old or best_old[a] < value:
                best_old[a] = value
            if b not in best_new or best_new[b] < value:
                best_new[b] = value
        mutual = [(a, b) for (a, b), value in pairs.items() if value == best_old[a] and value == best_new[b]]
        full = True
        while full:  # until a class runs out the same pairs stay best
            picks: dict = {}
            for a, b in mutual:
                picks[a] = min(picks.get(a, (new[b][-1], b)), (new[b][-1], b))
            takers: dict = {}
            for a, (_, b) in picks.items():
                takers[b] = min(takers.get(b, (old[a][-1], a)), (old[a][-1], a))
            for b, (_, a) in takers.items():
                (old_func, old_fid), (new_func, new_fid) = old[a].pop(), new[b].pop()
                yield old_fid, old_func, new_fid, new_func
                full = full and bool(old[a] and new[b])
        pairs = {(a, b): v for (a, b), v in pairs.items() if old[a] and new[b]}


def _matrix_links(a: np.ndarray, b: np.ndarray, rank: np.ndarray, old: dict, new: dict) -> Iterable[tuple]:
    """As :func:`_block_links` for a block of many classes; bests are found anew only where a class ran out."""
    names_old, x = np.unique(a, return_inverse=True)
    names_new, y = np.unique(b, return_inverse=True)
    score = np.full((len(names_old), len(names_new)), -1, np.int64)
    score[x, y] = rank

    def placed(names: np.ndarray, side: dict) -> tuple[list, list[list[int]], np.ndarray]:
        """All rows by name, the places of each class's rows (the first is the last of the list), the first places."""
        every = sorted((row, k) for k, name in enumerate(names.tolist()) for row in side[name])
        places: list[list[int]] = [[] for _ in names]
        for place in range(len(every) - 1, -1, -1):
            places[every[place][1]].append(place)
        return [row for row, _ in every], places, np.array([p[-1] for p in places])

    old_rows, old_places, old_head = placed(names_old, old)
    new_rows, new_places, new_head = placed(names_new, new)
    best_old, best_new = score.max(axis=1), score.max(axis=0)
    while True:
        x, y = np.nonzero((score == best_old[:, None]) & (score == best_new) & (score >= 0))
        if not len(x):
            return
        spent_old, spent_new = [], []
        while not (spent_old or spent_new):  # until a class runs out the same pairs stay best
            first = _first_of(x, new_head[y])
            pick_x, pick_y = x[first], y[first]
            first = _first_of(pick_y, old_head[pick_x])
            for i, j in zip(pick_x[first].tolist(), pick_y[first].tolist()):
                (old_func, old_fid), (new_func, new_fid) = old_rows[old_places[i].pop()], new_rows[new_places[j].pop()]
                yield old_fid, old_func, new_fid, new_func
                for spent, places, head, k in ((spent_old, old_places, old_head, i), (spent_new, new_places, new_head, j)):
                    if places[k]:
                        head[k] = places[k][-1]
                    else:
                        spent.append(k)
        changed_old = (score[:, spent_new] == best_old[:, None]).any(axis=1)
        changed_new = (score[spent_old] == best_new).any(axis=0)
        score[spent_old], score[:, spent_new] = -1, -1
        best_old[changed_old], best_new[changed_new] = score[changed_old].max(axis=1), score[:, changed_new].max(axis=0)
        best_old[spent_old], best_new[spent_new] = -1, -1
        live_old, live_new = np.flatnonzero(best_old >= 0), np.flatnonzero(best_new >= 0)
        if not len(live_old):
            return
        if len(live_old) * len(live_new) < 0.8 * score.size:
            score, best_old, best_new = score[np.ix_(live_old, live_new)], best_old[live_old], best_new[live_new]
            old_head, new_head = old_head[live_old], new_head[live_new]
            old_places, new_places = [old_places[k] for k in live_old], [new_places[k] for k in live_new]


def _first_of(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each group the index of its smallest place."""
    order = np.lexsort((place, group))
    return order[np.r_[True, np.diff(group[order]) != 0]]


def _active(rows: DataFrame, pairs: DataFrame, name: str, aliases: bool) -> DataFrame:
    """Rows whose class reaches the best score of their fid, with that score."""
    best = pairs.groupBy(name).agg(F.max("score").alias("best"), F.count("*").alias("partners"))
    active = rows.select("fid", "func", name).join(best, name)
    if not aliases:
        return active.withColumn("several", F.lit(False))
    of_fid = active.groupBy("fid").agg(
        F.max("best").alias("fid_best"), (F.count("*") > 1).alias("several")
    )
    return active.join(of_fid, "fid").where("best = fid_best").drop("fid_best")


def _mutual(pairs: DataFrame, active_old: DataFrame, active_new: DataFrame) -> DataFrame:
    """Class pairs that are best for both sides, with the first row of each class."""
    def heads(active: DataFrame, name: str, side: str) -> DataFrame:
        return active.groupBy(name).agg(
            F.first("best").alias(f"{side}_best"),
            F.min(F.struct("func", "fid")).alias(f"{side}_head"),
            F.count("*").alias(f"{side}_n"),
            F.max("several").alias(f"{side}_several"),
            F.first("partners").alias(f"{side}_partners"),
        )

    return (
        pairs.join(heads(active_old, "old_class", "old"), "old_class")
        .where("score = old_best").drop("old_best")
        .join(heads(active_new, "new_class", "new"), "new_class")
        .where("score = new_best").drop("new_best")
    )


def _ties(mutual: DataFrame) -> DataFrame:
    """Mark the pairs of class sets in which everything ties with everything."""
    picks = mutual.groupBy("old_class").agg(_set_of("new_class").alias("picks"))
    takers = mutual.groupBy("new_class").agg(_set_of("old_class").alias("takers"))
    edges = mutual.join(picks, "old_class").join(takers, "new_class")
    # all of `takers` pick exactly `picks` when every pair of the two sets is here
    whole = (F.count("*") == F.col("picks.n") * F.col("takers.n")) & ~F.max(F.col("old_several") | F.col("new_several"))
    outside = F.max((F.col("old_partners") > F.col("picks.n")) | (F.col("new_partners") > F.col("takers.n")))
    groups = edges.groupBy("picks", "takers").agg(whole.alias("bulk"), (~outside).alias("alone"))
    return edges.join(groups, ["picks", "takers"]).drop("old_several", "new_several", "old_partners", "new_partners")


def _set_of(column: str) -> Column:
    """A set of classes, named by its size and two 64-bit sums over its members."""
    return F.struct(
        F.count("*").alias("n"), F.sum(F.xxhash64(column).cast("decimal(38,0)")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("second"), column)).alias("b"),
    )


def _first_takers(ties: DataFrame, active_old: DataFrame, aliases: bool) -> DataFrame:
    choice = ties.groupBy("old_class").agg(
        F.min(F.struct("new_head.func", "new_head.fid")).alias("pick"), F.first("old_head").alias("old_head")
    )
    if aliases:
        taker = active_old.join(choice, "old_class").select("fid", "func", "pick")
        taker = taker.groupBy("fid").agg(F.min(F.struct("func", "pick")).alias("t")).select("fid", "t.*")
    else:
        taker = choice.select("old_head.fid", "old_head.func", "pick")
    first = taker.groupBy(F.col("pick.fid").alias("new_fid")).agg(
        F.min(F.struct(F.col("func").alias("old_func"), F.col("pick.func").alias("new_func"),
                       F.col("fid").alias("old_fid"))).alias("first")
    )
    return first.select("first.old_fid", "first.old_func", "new_fid", "first.new_func")


def _kth_with_kth(ties: DataFrame, active_old: DataFrame, active_new: DataFrame, largest: int,
                  bound: bool, one: bool) -> DataFrame:
    """K-th with k-th; in sets that are not ``alone`` (some, if ``bound``) only the next ranks (the first, if ``one``)."""
    sets = ["picks", "takers"]

    def ranked(active: DataFrame, name: str, side: str) -> DataFrame:
        rows = active.join(ties.select(name, *sets, "alone").distinct(), name).select(
            *sets, "alone", name, F.col("fid").alias(f"{side}_fid"), F.col("func").alias(f"{side}_func")
        )
        return positions(rows, sets, [f"{side}_func", f"{side}_fid"], largest=largest)

    old, new = ranked(active_old, "old_class", "old"), ranked(active_new, "new_class", "new")
    pairs = old.join(new.drop("alone"), [*sets, "position"])
    if bound:
        def last(rows: DataFrame, name: str) -> DataFrame:
            return rows.where("not alone").groupBy(*sets, name).agg(F.max("position").alias("last")).select("last")

        step = 1 if one else last(old, "old_class").unionByName(last(new, "new_class")).agg(F.min("last")).first()[0]
        pairs = pairs.where(F.col("alone") | (F.col("position") <= step))
    return pairs.select("old_fid", "old_func", "new_fid", "new_func")
