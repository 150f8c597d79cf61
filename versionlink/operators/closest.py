"""Most similar partner of each text inside a block, over whole blocks.

Texts are compared as distinct values, so copies are compared once. A value
that the other side holds too is its own best partner and is not compared
further by its side. The rest is a best-first search. Blocks are cut into tiles by
text length, so a few long texts fill no task, and a task searches its tiles: a value's
partners are taken by falling bound of similarity, from lengths and counts of
letters, and the search ends when the bound is under the best so far. A tile gives the
best partners of each value in it only; the best of all tiles are kept. Blocks of a few
short texts are compared directly, without tiles.

Sizes of blocks come from hashes and lengths, so that texts are only moved to be compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from versionlink.functions.edits import edit_distance
from versionlink.functions.text import digest
from versionlink.operators.pairing import block_join, weighed_tiles
from versionlink.session import keep, settle, union_all

GRAM = 2
# Row pairs, and cells of edit distances, of a block that one task searches for all similar pairs (bounds spare most cells); letters that one such task holds.
SMALL_BLOCK = 1 << 22
SMALL_CELLS = 1 << 35
TASK_LETTERS = 1 << 25
# Cells of edit distances that one tile holds.
TILE_CELLS = 1 << 32
LETTERS = 32
# Value pairs, and cells of edit distances, of a block that is one row.
ROW_PAIRS = 64
ROW_CELLS = 20_000
# Letters of a block without a partner that a task may hold; such blocks a task; so many more blocks of one row are worth their own way.
ONE_SIDED = 1 << 22
NONE_BLOCKS = 1_000
FEW_BLOCKS = 4
# Rows for each distinct text of a block from which on copies are left out before the texts are moved, not after.
MANY_COPIES = 1.5
BEST_SCHEMA = "old boolean, id bigint, partner bigint, similarity double"


def _similarity(a: Column, b: Column, least: Column | None = None) -> Column:
    """Edit similarity; null when it is surely below ``least``."""
    longest = F.greatest(F.length(a), F.length(b))
    if least is None:
        distance = F.levenshtein(a, b)
    else:
        limit = F.ceil((F.lit(1.0) - least) * longest).cast("int")
        distance = F.call_function("levenshtein", a, b, limit)
    return (
        F.when(longest == 0, F.lit(1.0))
        .when(distance >= 0, F.lit(1.0) - distance.cast("double") / longest)
    )


def _letters(text: str) -> np.ndarray:
    """How often each letter, by the last bits of its code point, stands in a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(points % LETTERS, minlength=LETTERS)


class Texts:
    """One side of a tile: ids, texts, which of them ask, and what bounds their similarity."""

    def __init__(self, rows: list[tuple[int, str, bool]]):
        self.ids, self.texts, self.asks = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.counts = np.array([_letters(t) for t in self.texts], np.int32).reshape(len(rows), LETTERS)

    def best(self, at: int, other: "Texts") -> tuple[float, list[int]]:
        """The best similarity of a text to those of ``other``, and all places that have it."""
        text, size = self.texts[at], self.size[at]
        surplus = np.maximum(self.counts[at] - other.counts, 0).sum(axis=1)
        longest = np.maximum(np.maximum(size, other.size), 1)
        # every surplus letter of either side takes an edit
        bound = 1.0 - np.maximum(surplus, surplus - (size - other.size)) / longest
        best, places = -1.0, []
        for place in np.argsort(-bound, kind="stable").tolist():
            if bound[place] < best:
                break
            length = int(longest[place])
            most = None if best < 0 else int((1.0 - best) * length + 1e-6)
            edits = edit_distance(text, other.texts[place], most)
            if edits is None:
                continue
            similarity = 1.0 - edits / length
            if similarity > best:
                best, places = similarity, []
            if similarity == best:
                places.append(place)
        return best, places


def _search(rows: Iterable[tuple]) -> list[tuple]:
    """Best partners in each tile of ``(tile, old, id, text, asks)``, as rows of ``BEST_SCHEMA``."""
    tiles: dict[tuple, tuple[list, list]] = {}
    for tile, old, *row in rows:
        tiles.setdefault(tile, ([], []))[0 if old else 1].append(tuple(row))
    found = []
    for sides in tiles.values():
        left, right = map(Texts, sides)
        for own, other, old in ((left, right, True), (right, left, False)):
            if not other.ids:
                continue
            for at, asks in enumerate(own.asks):
                if asks:
                    best, places = own.best(at, other)
                    found += [(old, own.ids[at], other.ids[k], best) for k in places]
    return found


def _search_bucket(table: pa.Table) -> pa.Table:
    tile = [tuple(t.values()) for t in table.column("__tile").to_pylist()]
    found = _search(zip(tile, *[table.column(c).to_pylist() for c in ("__old", "id", "text", "asks")]))
    values = list(zip(*found)) if found else [[]] * 4
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
    names = [c.split()[0] for c in BEST_SCHEMA.split(", ")]
    return pa.table([pa.array(list(v), t) for v, t in zip(values, types)], names=names)


def closest(left: DataFrame, right: DataFrame, block: list[str], l: str, r: str,
            for_left: bool = True, for_right: bool = True, tile_cells: int = TILE_CELLS,
            sizes: tuple[DataFrame, DataFrame] | None = None, digests: bool = False) -> DataFrame:
    """All value pairs of a block that are best for at least one asked side.

    Returns ``block``, ``l``, ``r``, ``similarity``, ``best_left``,
    ``best_right``; ties are all returned. Null texts have no partner. ``sizes`` are the rows of both sides
    with a hash ``__h`` and the length ``__n`` in place of the text, where they are had without moving texts.
    With ``digests``, ``l`` and ``r`` are the digests of the texts.
    """
    own_l, own_r = left.select(*block, l).where(F.col(l).isNotNull()), right.select(*block, r).where(F.col(r).isNotNull())
    sized = lambda own, c: own.select(*block, F.xxhash64(c).alias("__h"), F.length(c).alias("__n"))

    def size(own: DataFrame, name: str) -> DataFrame:
        texts = own.where("__n is not null").groupBy(*block, "__h", "__n").agg(F.count("*").alias("__rows"))
        return texts.groupBy(*block).agg(F.count("*").alias(name), F.sum(F.col("__n") + 1).alias(f"{name}_weight"),
                                         F.sum((F.col("__n") + 1) * F.col("__rows")).alias(f"{name}_letters"))

    sizes = sizes or (sized(own_l, l), sized(own_r, r))
    work = F.col("__a_weight").cast("double") * F.col("__b_weight")
    fits = (F.col("__a") * F.col("__b") <= ROW_PAIRS) & (work <= ROW_CELLS)
    # a block of one side has no pair, but its texts must not fill a task
    kind = F.when(work.isNull(), F.when(F.coalesce("__a_weight", "__b_weight") > ONE_SIDED, "large").otherwise("none")).when(
        fits, "fits").when(work > tile_cells, "large").otherwise("whole")
    both = lambda name: F.coalesce(f"__a{name}", F.lit(0)) + F.coalesce(f"__b{name}", F.lit(0))
    met = keep(size(sizes[0], "__a").join(size(sizes[1], "__b"), block, "full").select(
        *block, kind.alias("__kind"), F.coalesce(work, F.lit(0.0)).alias("__work"),
        both("_weight").alias("__distinct"), both("_letters").alias("__letters")))
    totals = met.groupBy("__kind").agg(
        F.count("*"), F.sum("__work"), F.sum("__distinct"), F.sum("__letters"),
        F.max((F.col("__letters") > ONE_SIDED) & (F.col("__letters") > MANY_COPIES * F.col("__distinct")))).collect()
    counts = {k: (n, w) for k, n, w, *_ in totals}
    if any(t[5] for t in totals) or sum(t[4] for t in totals) > MANY_COPIES * sum(t[3] for t in totals):
        own_l, own_r = own_l.distinct(), own_r.distinct()
    count = lambda k: counts.get(k, (0, 0.0))[0]
    shown = (lambda df: df.withColumns({c: digest(F.col(c)) for c in (l, r)})) if digests else lambda df: df
    if not count("whole") and not counts.get("large", (0, 0.0))[1]:
        return shown(_in_rows(own_l, own_r, block, l, r, for_left, for_right))
    only = lambda own, which: own.join(met.where(which).select(*block), block, "left_semi")
    parts = []
    rows = count("fits") > FEW_BLOCKS * count("whole")
    if rows:
        parts.append(shown(_in_rows(only(own_l, "__kind = 'fits'"), only(own_r, "__kind = 'fits'"), block, l, r, for_left, for_right)))
    if count("large"):
        large = "__kind = 'large' and __work > 0"
        parts.append(shown(_in_tiles(only(own_l.distinct(), large), only(own_r.distinct(), large), block, l, r, for_left, for_right, tile_cells)))
    if count("whole"):
        kinds = "__kind = 'whole'" if rows else "__kind in ('whole', 'fits')"
        rest = lambda own: only(own, kinds) if rows or count("large") else own
        tasks = math.ceil(sum(w for k, (_, w) in counts.items() if k in ("whole", "fits")) / tile_cells) + count("none") // NONE_BLOCKS
        parts.append(_in_tasks(rest(own_l), rest(own_r), block, l, r, for_left, for_right, tasks, digests))
    return union_all(parts)


def _best_in_block(left: Texts, right: Texts, for_left: bool, for_right: bool) -> list[tuple[int, int, float, bool, bool]]:
    """Pairs of places of a whole block with their similarity and the sides they are best for."""
    found: dict[tuple[int, int], list] = {}
    place = {text: k for k, text in enumerate(right.texts)}
    for at, text in enumerate(left.texts):
        if text in place:
            found[at, place[text]] = [1.0, for_left, for_right]
            left.asks[at] = right.asks[place[text]] = False
    for own, other, side in ((left, right, 1), (right, left, 2)):
        for at, asks in enumerate(own.asks):
            if asks:
                best, places = own.best(at, other)
                for k in places:
                    pair = found.setdefault((at, k) if side == 1 else (k, at), [best, False, False])
                    pair[side] = True
    return [(o, n, *row) for (o, n), row in found.items()]


def _in_tasks(own_l: DataFrame, own_r: DataFrame, block: list[str], l: str, r: str,
              for_left: bool, for_right: bool, tasks: int, digests: bool) -> DataFrame:
    """:func:`closest` for blocks that one task can search; each text is moved once, and copies are left out there."""
    def named(texts: pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
        return pa.array([hashlib.sha256(t.encode()).digest() for t in texts.to_pylist()], pa.binary()) if digests else texts

    def search(table: pa.Table) -> pa.Table:
        sides: dict[tuple, tuple[dict, dict]] = {}
        keys = zip(*[table.column(c).to_pylist() for c in block])
        for at, (key, old, text) in enumerate(zip(keys, table.column("__old").to_pylist(), table.column("__text").to_pylist())):
            if None not in key:
                sides.setdefault(key, ({}, {}))[0 if old else 1].setdefault(text, at)
        found = []
        for rows in sides.values():
            if all(rows):
                left, right = (Texts([(at, text, asks) for text, at in side.items()]) for side, asks in zip(rows, (for_left, for_right)))
                found += [(left.ids[o], right.ids[n], *row) for o, n, *row in _best_in_block(left, right, for_left, for_right)]
        a, b, *scores = [list(c) for c in zip(*found)] if found else [[]] * 5
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        scores = [pa.array(c, t) for c, t in zip(scores, (pa.float64(), pa.bool_(), pa.bool_()))]
        texts = table.column("__text")
        return pa.table([*[table.column(c).take(a) for c in block], named(texts.take(a)), named(texts.take(b)), *scores],
                        names=[*block, l, r, "similarity", "best_left", "best_right"])

    side = lambda own, c, old: own.select(*block, F.lit(old).alias("__old"), F.col(c).alias("__text"))
    both = side(own_l, l, True).unionByName(side(own_r, r, False))
    buckets = max(int(own_l.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    text = digest(F.col("__text")) if digests else F.col("__text")
    schema = both.select(*block, text.alias(l), text.alias(r), F.lit(0.0).alias("similarity"),
                         F.lit(True).alias("best_left"), F.lit(True).alias("best_right")).schema
    bucket = F.pmod(F.xxhash64(*block), F.lit(buckets)).alias("__bucket")
    return both.select(bucket, "*").groupBy("__bucket").applyInArrow(search, schema)


def _in_rows(own_l: DataFrame, own_r: DataFrame, block: list[str], l: str, r: str, for_left: bool, for_right: bool) -> DataFrame:
    """:func:`closest` for small blocks, each block in one row."""
    lists = lambda own, c, name: own.groupBy(*block).agg(F.collect_set(c).alias(name))
    both = lists(own_l, l, "__ls").join(lists(own_r, r, "__rs"), block)
    row = lambda a: F.transform("__rs", lambda b: F.when(a == b, F.lit(1.0)).otherwise(_similarity(a, b)))
    scored = both.withColumn("__scores", F.transform("__ls", row))
    best_r = F.transform(F.sequence(F.lit(0), F.size("__rs") - 1), lambda j: F.array_max(F.transform("__scores", lambda s: F.get(s, j))))
    scored = scored.withColumn("__best_r", best_r)
    rows = scored.select(*block, "__rs", "__best_r", F.explode(F.arrays_zip("__ls", "__scores")).alias("__l")).select(
        *block, F.col("__l.__ls").alias(l), F.array_max("__l.__scores").alias("__best_l"),
        F.explode(F.arrays_zip("__rs", "__best_r", F.col("__l.__scores").alias("__s"))).alias("__p"))
    at_best = lambda best, asked: (F.col("similarity") == F.col(best)) & F.lit(asked)
    pairs = rows.select(*block, l, F.col("__p.__rs").alias(r), F.col("__p.__s").alias("similarity"), "__best_l", F.col("__p.__best_r").alias("__best_r"))
    # equal texts are always returned, as in the tiles
    return pairs.select(*block, l, r, "similarity", at_best("__best_l", for_left).alias("best_left"),
                        at_best("__best_r", for_right).alias("best_right")).where(F.col("best_left") | F.col("best_right") | (F.col(l) == F.col(r)))


def _in_tiles(own_l: DataFrame, own_r: DataFrame, block: list[str], l: str, r: str,
              for_left: bool, for_right: bool, tile_cells: int) -> DataFrame:
    """:func:`closest` for distinct values of blocks of any size."""
    def values(own: DataFrame, other: DataFrame, c: str, o: str) -> DataFrame:
        """Distinct values with a number, and whether the other side holds them."""
        equal = other.select(*block, F.col(o).alias(c), F.lit(True).alias("equal"))
        return keep(own.join(equal, [*block, c], "left").withColumn("id", F.monotonically_increasing_id()))

    values_l, values_r = values(own_l, own_r, l, r), values(own_r, own_l, r, l)
    same = values_l.where("equal").select(
        *block, l, F.col(l).alias(r), F.lit(1.0).alias("similarity"),
        F.lit(for_left).alias("best_left"), F.lit(for_right).alias("best_right"),
    )

    def texts(side: DataFrame, c: str, asked: bool) -> DataFrame:
        return side.select(
            *block, "id", F.col(c).alias("text"), (F.col("equal").isNull() & F.lit(asked)).alias("asks"),
            (F.length(c) + 1).alias("__weight"))

    old, new = texts(values_l, l, for_left), texts(values_r, r, for_right)
    asking = old.where("asks").select(*block).unionByName(new.where("asks").select(*block)).distinct()
    only = lambda side: side.join(asking, block, "left_semi")
    tiles, tasks = weighed_tiles(only(old), only(new), block, "__weight", tile_cells)
    buckets = max(int(own_l.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    bucket = F.pmod(F.xxhash64("__tile"), F.lit(buckets)).alias("bucket")
    found = settle(tiles.select(bucket, "*").groupBy("bucket").applyInArrow(_search_bucket, BEST_SCHEMA))
    best = found.groupBy("old", "id").agg(F.max("similarity").alias("best"))
    found = found.join(best, ["old", "id"]).where("similarity = best")
    pair = lambda old, a, b: F.when(F.col("old") == old, F.col(a)).otherwise(F.col(b))
    pairs = found.groupBy(pair(True, "id", "partner").alias("__l"), pair(True, "partner", "id").alias("__r")).agg(
        F.first("similarity").alias("similarity"), F.max(F.col("old")).alias("best_left"), F.max(~F.col("old")).alias("best_right"))
    return (
        pairs.join(values_l.select(*block, l, F.col("id").alias("__l")), "__l")
        .join(values_r.select(r, F.col("id").alias("__r")), "__r")
        .select(*block, l, r, "similarity", "best_left", "best_right").unionByName(same)
    )


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], l: str, r: str,
                  at_least: float, small_block: int = SMALL_BLOCK) -> DataFrame:
    """Every value pair of a block with edit similarity of ``at_least`` or more.

    Blocks of up to ``small_block`` row pairs that fit one task are searched there whole; in larger
    ones pairs are met by an equi-join on rare grams.
    """
    _gram_bound(at_least)
    whole, large, tasks = _split_blocks(left, right, block, l, r, small_block)

    def found(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[int, int, float]]:
        return [(old[a][0], new[b][0], s) for a, b, s in _near_in_block(old, new, at_least)]

    near = _near_in_tasks(*whole, block, l, r, [], [], tasks, found)
    return near if large is None else near.unionByName(_similar_by_grams(*large, block, l, r, at_least))


def similar_rows(left: DataFrame, right: DataFrame, block: list[str], l: str, r: str, keep_l: list[str], keep_r: list[str],
                 at_least: float, small_block: int = SMALL_BLOCK, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Row pairs of a block with edit similarity of ``at_least`` or more that is the best there for either text.

    Returns ``block``, ``keep_l``, ``keep_r`` and ``similarity``: texts are moved once, to the task that compares them.
    ``sizes`` are the rows of both sides with the length ``__n`` in place of the text, where they are had without moving texts.
    """
    _gram_bound(at_least)
    whole, large, tasks = _split_blocks(left, right, block, l, r, small_block, sizes)

    def found(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[int, int, float]]:
        near = _near_in_block(old, new, at_least, best_only=True)
        return [(i, j, s) for a, b, s in near for i in old[a] for j in new[b]]

    near = _near_in_tasks(*whole, block, l, r, keep_l, keep_r, tasks, found)
    if large is None:
        return near
    codes = _similar_by_grams(*large, block, l, r, at_least)
    best = lambda c, out: codes.groupBy(*block, c).agg(F.max("similarity").alias(out))
    codes = settle(codes.join(best(l, "__l"), [*block, l]).join(best(r, "__r"), [*block, r])
                   .where("similarity = __l or similarity = __r").drop("__l", "__r"))
    return near.unionByName(codes.join(large[0], [*block, l]).join(large[1], [*block, r]).select(*near.columns))


def _gram_bound(at_least: float) -> None:
    if at_least < 0.8:
        raise ValueError("the gram filter is exact from 0.8 on")


def _split_blocks(left: DataFrame, right: DataFrame, block: list[str], l: str, r: str, small_block: int,
                  sizes: tuple[DataFrame, DataFrame] | None = None):
    """Both sides' rows of blocks that one task searches, those of larger blocks (None without one), and a number of tasks."""
    left, right = left.where(F.col(l).isNotNull()), right.where(F.col(r).isNotNull())
    sized = lambda side, c: side.select(*block, F.length(c).alias("__n"))
    sizes = sizes or (sized(left, l), sized(right, r))
    size = lambda side, name: side.where("__n is not null").groupBy(*block).agg(
        F.count("*").cast("double").alias(name), F.sum(F.col("__n") + 1).cast("double").alias(f"{name}_weight"))
    work = F.col("__a_weight") * F.col("__b_weight")
    # a block of one side has no pair, but its texts must not fill a task
    large = F.coalesce((F.col("__a") * F.col("__b") > small_block) | (work > SMALL_CELLS), F.coalesce("__a_weight", "__b_weight") > ONE_SIDED)
    met = keep(size(sizes[0], "__a").join(size(sizes[1], "__b"), block, "full").select(
        *block, large.alias("__large"), F.coalesce(work, F.lit(0.0)).alias("__work"),
        (F.coalesce("__a_weight", F.lit(0.0)) + F.coalesce("__b_weight", F.lit(0.0))).alias("__letters")))
    some, work, letters = met.agg(F.max("__large"), F.sum(F.when(~F.col("__large"), F.col("__work"))),
                                  F.sum(F.when(~F.col("__large"), F.col("__letters")))).first()
    tasks = math.ceil(max((work or 0.0) / SMALL_CELLS, (letters or 0.0) / TASK_LETTERS))
    if not some:
        return (left, right), None, tasks
    large = met.where("__large").select(*block)
    kind = lambda how: tuple(side.join(large, block, how) for side in (left, right))
    return kind("left_anti"), kind("left_semi"), tasks


def _near_in_block(left: dict[str, list[int]], right: dict[str, list[int]], at_least: float,
                   best_only: bool = False) -> list[tuple[str, str, float]]:
    """Text pairs with a similarity of ``at_least``; with ``best_only``, those best for either text."""
    found = [(text, text, 1.0) for text in left if text in right]
    others = sorted(right, key=len)
    if best_only:
        # a text with an equal partner has its best; two such texts need no distance
        asking = [t for t in others if t not in left]
    size = lambda texts: np.array([len(t) for t in texts], np.int64)
    sides: dict[int, tuple[list, np.ndarray, list]] = {0: (others, size(others), [])}
    if best_only:
        sides[1] = (asking, size(asking), [])
    for text in left:
        texts, sizes, counts = sides[1 if best_only and text in right else 0]
        low = int(np.searchsorted(sizes, at_least * len(text) - 1e-6))
        high = int(np.searchsorted(sizes, len(text) / at_least + 1e-6, "right"))
        if low == high or (high - low == 1 and texts[low] == text):
            continue
        if not counts:
            counts.append(np.array([_letters(t) for t in texts], np.int32))
        longest = np.maximum(sizes[low:high], len(text))
        surplus = np.maximum(_letters(text) - counts[0][low:high], 0).sum(axis=1)
        most = ((1.0 - at_least) * longest + 1e-6).astype(np.int64)
        # every surplus letter of either side takes an edit
        for k in np.flatnonzero(np.maximum(surplus, surplus - (len(text) - sizes[low:high])) <= most).tolist():
            other = texts[low + k]
            if other != text:
                edits = edit_distance(text, other, int(most[k]))
                if edits is not None and (similarity := 1.0 - edits / int(longest[k])) >= at_least:
                    found.append((text, other, similarity))
    if not best_only:
        return found
    best: tuple[dict, dict] = {}, {}
    for a, b, s in found:
        best[0][a], best[1][b] = max(s, best[0].get(a, s)), max(s, best[1].get(b, s))
    return [(a, b, s) for a, b, s in found if s in (best[0][a], best[1][b])]


def _near_in_tasks(left: DataFrame, right: DataFrame, block: list[str], l: str, r: str, keep_l: list[str], keep_r: list[str],
                   tasks: int, found) -> DataFrame:
    """Row pairs that ``found`` gives for each block, as ``block``, the kept columns (without any: the texts) and ``similarity``."""
    texts = not keep_l and not keep_r

    def search(table: pa.Table) -> pa.Table:
        sides: dict[tuple, tuple[dict, dict]] = {}
        keys = zip(*[table.column(c).to_pylist() for c in block])
        for at, (key, old, text) in enumerate(zip(keys, table.column("__old").to_pylist(), table.column("__text").to_pylist())):
            if None not in key:
                sides.setdefault(key, ({}, {}))[0 if old else 1].setdefault(text, []).append(at)
        pairs = [pair for old, new in sides.values() if old and new for pair in found(old, new)]
        a, b, similarity = [list(c) for c in zip(*pairs)] if pairs else [[]] * 3
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        columns = [(c, table.column(c).take(a)) for c in block]
        if texts:
            columns += [(l, table.column("__text").take(a)), (r, table.column("__text").take(b))]
        columns += [(c, table.column(c).take(a)) for c in keep_l] + [(c, table.column(c).take(b)) for c in keep_r]
        columns.append(("similarity", pa.array(similarity, pa.float64())))
        return pa.table([c for _, c in columns], names=[name for name, _ in columns])

    side = lambda own, c, old, keep: own.select(*block, F.lit(old).alias("__old"), F.col(c).alias("__text"), *keep)
    both = side(left, l, True, keep_l).unionByName(side(right, r, False, keep_r), allowMissingColumns=True)
    buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    out = [F.col("__text").alias(l), F.col("__text").alias(r)] if texts else [*keep_l, *keep_r]
    schema = both.select(*block, *out, F.lit(0.0).alias("similarity")).schema
    bucket = F.pmod(F.xxhash64(*block), F.lit(buckets)).alias("__bucket")
    return both.select(bucket, "*").groupBy("__bucket").applyInArrow(search, schema)


def _similar_by_grams(left: DataFrame, right: DataFrame, block: list[str], l: str, r: str, at_least: float) -> DataFrame:
    """:func:`similar_pairs` for blocks of any size.

    Equal values are met by an equi-join, also those too short to have a gram; a
    text of one letter has no other partner from 0.8 on. Other
    pairs are met by an equi-join on rare grams: texts within d edits share
    a two-letter gram among the 2d+1 rarest of each (d is the most edits the
    bound allows for a text's length). From 0.8 on every text has that many
    grams, and the filter loses nothing.
    """
    # the hash only names a text in the gram join; texts that share one are all compared
    own_l = settle(left.select(*block, l, F.xxhash64(l).alias("__l"), F.length(l).alias("__ll")).distinct())
    own_r = settle(right.select(*block, r, F.xxhash64(r).alias("__r"), F.length(r).alias("__rl")).distinct())
    shorter, longer = F.least("__ll", "__rl"), F.greatest("__ll", "__rl")
    fits = shorter >= longer * at_least
    texts = own_l.select(F.col(l).alias("__text")).unionByName(own_r.select(F.col(r).alias("__text"))).distinct()
    rare = settle(_rare_grams(texts, at_least))
    tagged = lambda side, text, *c: side.join(rare.withColumnRenamed("__text", text), text).select(
        *block, *c, "__gram", "__k")
    met = block_join(tagged(own_l, l, "__l", "__ll"), tagged(own_r, r, "__r", "__rl"), [*block, "__gram", "__k"])
    met = met.where(fits).select(*block, "__l", "__r").distinct()
    near = met.join(own_l, [*block, "__l"]).join(own_r, [*block, "__r"]).where(F.col(l) != F.col(r)).select(*block, l, r)
    same = own_l.select(*block, l).join(own_r.select(*block, F.col(r).alias(l)), [*block, l]).select(
        *block, l, F.col(l).alias(r), F.lit(1.0).alias("similarity")
    )
    similar = near.select(*block, l, r, _similarity(F.col(l), F.col(r), F.lit(at_least)).alias("similarity"))
    return similar.where(F.col("similarity") >= at_least).unionByName(same)


def _rare_grams(texts: DataFrame, at_least: float) -> DataFrame:
    """The rarest two-letter grams of each text, as many as its edits could break, plus one.

    The k-th equal gram of a text is a gram of its own.
    """
    starts = F.sequence(F.lit(1), F.length("__text") - GRAM + 1)
    grams = texts.where(F.length("__text") >= GRAM).select("__text", F.explode(starts).alias("__at"))
    grams = grams.select("__text", F.substr("__text", "__at", F.lit(GRAM)).alias("__gram"))
    counted = grams.groupBy("__text", "__gram").agg(F.count("*").alias("__n"))
    counted = settle(counted.select("__text", "__gram", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k")))
    spread = counted.groupBy("__gram", "__k").agg(F.count("*").alias("__texts"))
    # one list per text, no longer than the text
    ordered = counted.join(spread, ["__gram", "__k"]).groupBy("__text").agg(
        F.array_sort(F.collect_list(F.struct("__texts", "__gram", "__k"))).alias("__list")
    )
    edits = F.floor(F.lit((1 - at_least) / at_least) * F.length("__text") + 1e-9)
    kept = F.slice(F.col("__list"), F.lit(1), (edits * GRAM + 1).cast("int"))
    return ordered.select("__text", F.explode(kept).alias("__g")).select("__text", "__g.__gram", "__g.__k")
