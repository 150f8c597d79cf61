"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A document is its set of distinct word shingles. Its signature has ``COORDINATES``
least values, and two sets of Jaccard similarity s agree in each coordinate with
probability s. Two documents linked at ``percent`` per hundred therefore agree
in at least ``matches`` coordinates, but for a chance below one in a hundred thousand at
the bound itself (see ``least_matches``), and far below it for closer texts.

1. Equal sets form one class; signatures are made per class.
2. Each class is posted under its (coordinate, value) pairs. Pairs nobody shares
   are dropped. Two classes that agree ``m`` times or more must meet outside the
   ``m - 1`` longest posting lists of either, so a class skips its ``m - 1``
   longest lists (prefix) and is gone when it shares fewer than ``m``.
3. Each list is joined with one member only, its head: the heaviest at first, then,
   where components still differ, the one with most links so far. Agreeing
   coordinates of those pairs are counted, the survivors are checked on the full
   sets, and components are taken. At last, members of one list whose components
   still differ are looked at: pair by pair in short lists, by their differences
   from the head in long ones (see ``_by_difference``). A list of thousands of
   copies thus costs a pair or two per member, linked with each other or not.

Row cases: null or blank text has an empty set and stays alone. Equal rows are
copies of each other. Rows that share an id are judged by their texts. A row
without an id takes part; its component is the least id found, null if none. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, stored, text_blocks, wide_key
from versionlink.llm.components import components
from versionlink.llm.hashing import Words, mix, run_hashes

SHINGLE = 5
COORDINATES = 32
STEP = 1 << 14
FEW = 16
ROUNDS = 2
_RANDOM = np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 63, (2, 256), dtype=np.uint64)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = 1e-5) -> int:
    """The most agreeing coordinates that a pair at the bound misses with probability ``miss`` at most."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def _sets(texts: list[bytes], length: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    windows = words.windows(hashes, length)
    for k in range(len(texts)):
        n = int(words.counts[k])
        if n == 0:
            yield np.empty(0, np.uint64)
        elif n < length:
            yield run_hashes(hashes[words.of(k)], np.array([0]), np.array([n])) ^ np.uint64(n)
        else:
            yield np.unique(windows[words.of_windows(k, length)])


def _signature(items: np.ndarray, coordinates: int) -> np.ndarray:
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    turn, factor = _RANDOM[0, :coordinates, None], _RANDOM[1, :coordinates, None] | np.uint64(1)
    for at in range(0, len(items), STEP):
        values = (items[None, at : at + STEP] ^ turn) * factor
        values ^= values >> np.uint64(32)
        np.minimum(least, values.min(axis=1), out=least)
    return mix(least + np.arange(coordinates, dtype=np.uint64))


def sketch(docs: DataFrame, length: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, row, n_shingles, class, signature``; ``class`` names the set (null: empty set)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in text_blocks(batches):
            sizes, names, signatures = [], [], []
            for items in _sets(texts, length):
                sizes.append(len(items))
                names.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                signatures.append(_signature(items, coordinates).view(np.int64).tolist() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(signatures, pa.list_(pa.int64()))],
                ["doc_id", "row", "n_shingles", "class", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), wide_key().alias("row"), "text").mapInArrow(
        run, "doc_id long, row binary, n_shingles long, class binary, signature array<long>"
    )


def _full_sets(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for _, texts in text_blocks(batches):
            names, items = [], []
            for values in _sets(texts, length):
                names.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                items.append(values.view(np.int64))
            ends = np.cumsum([0, *map(len, items)]).astype(np.int32)
            flat = pa.array(np.concatenate(items) if items else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["class", "items"]
            )

    return docs.select("text").mapInArrow(run, "class binary, items array<long>")


def _prefix(classes: DataFrame, matches: int) -> DataFrame:
    """``key, class, weight``: each class's postings without its ``matches - 1`` longest lists.

    ``weight``, the lengths of all its lists together, is high for the middle of a
    group of copies.
    """
    postings = classes.select("class", F.explode("signature").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = postings.join(lists, "key").groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"),  # at most one per coordinate
        F.sum("n").alias("weight"),
    )
    kept = shared.filter(F.size("own") >= matches).select(
        "class", "weight", F.explode(F.slice("own", 1, F.size("own") - F.lit(matches - 1))).alias("p")
    )
    return kept.select(F.col("p.key").alias("key"), "class", "weight")


def _sets_of(wanted: DataFrame, docs: DataFrame, sketches: DataFrame, length: int) -> DataFrame:
    """``class, items`` for the classes in ``wanted``, made anew from one text of each."""
    rows = sketches.join(wanted, "class").groupBy("class").agg(F.min("row").alias("row")).select("row")
    texts = docs.select(wide_key().alias("row"), "text").join(rows, "row", "left_semi")
    return _full_sets(texts, length).join(wanted, "class", "left_semi").dropDuplicates(["class"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for name in ("a", "b"):
        side = sets.select(F.col("class").alias(name), F.col("items").alias(f"i_{name}"))
        pairs = pairs.join(side, name)
    return pairs


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs that agree in enough coordinates, and then reach the similarity on their full sets."""
    for name in ("a", "b"):
        side = classes.select(
            F.col("class").alias(name), F.col("signature").alias(f"s_{name}"), F.col("n_shingles").alias(f"n_{name}")
        )
        pairs = pairs.join(side, name)
    hits = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)")
    agreeing = pairs.filter(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (hits >= matches)
    ).select("a", "b")
    common = F.size(F.array_intersect("i_a", "i_b"))
    return _with_sets(stored(agreeing), sets).filter(
        100 * common >= percent * (F.size("i_a") + F.size("i_b") - common)
    ).select("a", "b")


def _few(labelled: DataFrame) -> DataFrame:
    """Pairs of different components in lists of ``FEW`` members at most."""

    def side(name: str) -> DataFrame:
        return labelled.filter(F.col("n") <= FEW).select(
            "key", F.col("class").alias(name), F.col("label").alias(f"l_{name}")
        )

    return side("a").join(side("b"), "key").filter("a < b and l_a <> l_b").select("a", "b").distinct()


def _by_difference(labelled: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in longer lists that can still be similar.

    Every member ``a`` is written as its differences ``D(a)`` from the list's head,
    so that a pair differs in ``|D(a)| + |D(b)| - 2 |D(a) & D(b)|`` shingles, which a
    linked pair keeps within ``t``, a share of both sizes. A difference that only
    one member has is never common; with ``u`` of those and ``s`` others, a link
    needs ``|D(a)| + u(b) - s(b) <= t`` and ``|D(a)| + u(b) - t`` common ones or
    more. Members linked with the head are one component already, so one side is
    not, and such a side always needs a common difference. It is posted under its
    rarest differences, and joined with members that can still have enough in common
    behind the place of the shared one. In a group of copies hardly any pair is left.
    """
    share = (100 - percent) / (100 + percent)
    size = F.size("items")
    group = labelled.filter(F.col("n") > FEW).select("head", "class", "label").distinct().filter("head <> class")
    both = _with_sets(group.select(F.col("head").alias("a"), F.col("class").alias("b"), "label"), sets)
    apart = F.transform(F.array_except("i_a", "i_b"), lambda x: F.xxhash64(F.lit("-"), x))
    more = F.transform(F.array_except("i_b", "i_a"), lambda x: F.xxhash64(F.lit("+"), x))
    items = stored(both.select(
        F.col("a").alias("head"), F.col("b").alias("class"), "label", F.size("i_b").alias("size"),
        F.concat(apart, more).alias("items"),
    ))
    each = items.select("head", "class", F.explode("items").alias("item"))
    often = each.groupBy("head", "item").agg(F.count("*").alias("often")).filter("often > 1")
    own = each.join(often, ["head", "item"]).groupBy("head", "class").agg(
        F.sort_array(F.collect_list(F.struct("often", "item"))).alias("common")  # bounded by two texts
    )
    near = links.select(F.col("a").alias("head"), F.col("b").alias("class")).unionByName(
        links.select(F.col("b").alias("head"), F.col("a").alias("class"))
    ).withColumn("near", F.lit(True))
    state = (
        items.withColumn("d", size).drop("items").join(own, ["head", "class"])
        .withColumn("gain", 2 * F.size("common") - F.col("d"))  # s - u
        .join(near, ["head", "class"], "left")
    )
    state = stored(state)
    whole = state.groupBy("head").agg(F.max("size").alias("largest"), F.max("gain").alias("best"))
    most = share * (F.col("size") + F.least("largest", F.floor(F.col("size") * 100 / percent)))
    left = (
        state.filter("near is null").join(whole, "head").withColumn("short", F.ceil(F.col("d") - most - 1e-9))
        .filter("short <= best")
        .withColumn("posted", F.size("common") - F.greatest("short", F.lit(1)) + 1).filter("posted > 0")
    )

    def posted(rows: DataFrame, name: str, common) -> DataFrame:
        return rows.select(
            "head", F.col("class").alias(name), F.col("label").alias(f"l_{name}"), F.col("size").alias(f"n_{name}"),
            F.col("d").alias(f"d_{name}"), F.col("gain").alias(f"g_{name}"), F.size("common").alias(f"s_{name}"),
            F.posexplode(common).alias(f"at_{name}", "c"),
        ).withColumn("item", F.col("c.item")).drop("c")

    asks = posted(left, "a", F.slice("common", 1, F.col("posted").cast("int")))
    least = left.groupBy("head").agg(F.min("short").alias("least"))
    gives = posted(state.join(least, "head").filter("gain >= least"), "b", F.col("common"))
    spare = F.lit(share) * (F.col("n_a") + F.col("n_b")) + 1e-9 - F.col("d_a") - F.col("d_b")
    rest = 2 * F.least(F.col("s_a") - F.col("at_a"), F.col("s_b") - F.col("at_b"))  # at the first common difference
    found = asks.join(gives, ["head", "item"]).filter((F.col("a") != F.col("b")) & F.expr("l_a <> l_b") & (spare + rest >= 0))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _marked(docs: DataFrame, percent: int, length: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """One row per document: ``doc_id, row, n_shingles, label``; ``label`` names the component (null: empty set)."""
    matches = least_matches(percent, coordinates)
    rows = docs.select("doc_id", "text")
    made = stored(sketch(rows, length, coordinates))
    classes = stored(made.filter("class is not null").dropDuplicates(["class"]).select(
        "class", "n_shingles", "signature"
    ))
    lists = stored(_prefix(classes, matches))
    sets = stored(_sets_of(lists.select("class").distinct(), rows, made, length))

    tried, links = None, None
    for _ in range(ROUNDS):
        heads = lists.groupBy("key").agg(
            F.max(F.struct("weight", "class")).alias("head"), F.count("*").alias("n")
        ).select("key", F.col("head.class").alias("head"), "n")
        member = stored(lists.join(heads, "key"))
        pairs = member.filter("class <> head").select(
            F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")
        ).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_linked(pairs, classes, sets, matches, percent))
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        labelled = member.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "label", F.coalesce("label", "class")
        )
        different = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m")
        labelled = stored(labelled.join(different.select("key"), "key", "left_semi"))
        degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(
            F.count("*").alias("weight")
        )
        lists = stored(labelled.select("key", "class").join(degree, "class", "left"))
    second = _few(labelled).unionByName(_by_difference(labelled, sets, links, percent)).distinct()
    second = stored(second.join(tried, ["a", "b"], "left_anti"))
    labels = components(links.unionByName(stored(_linked(second, classes, sets, matches, percent))))

    return made.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "doc_id", "row", "n_shingles", F.coalesce("label", "class").alias("label")
    )


def near_duplicates(
    docs: DataFrame, percent: int = 80, length: int = SHINGLE, coordinates: int = COORDINATES
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` at ``percent`` per hundred or more."""
    marked = _marked(docs, percent, length, coordinates).drop("row")
    least = marked.filter("label is not null").groupBy("label").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n")
    ).filter("n > 1")
    return marked.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("least", "doc_id"), F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates: of each component the least id stays, once.

    Rows are told apart by ``wide_key``: texts of different components stay even if they
    share an id, and of different texts of one component with its least id one stays; of equal rows
    one. Rows without an id cannot be named as copies and stay as they are. A document's own
    columns travel in a struct, so their names clash with nothing.
    """
    marked = _marked(docs, percent).filter("doc_id is not null").drop("n_shingles")
    first = marked.filter("label is not null").groupBy("label").agg(
        F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")
    ).filter("n > 1")
    stay = marked.join(first, "label", "left").filter("first is null or row = first.row").groupBy("row").agg(
        F.count("*").alias("rows")
    )
    named = docs.select(F.struct(*docs.columns).alias("doc"), wide_key().alias("row"), "doc_id").filter("doc_id is not null")
    named = named.drop("doc_id").join(stay, "row")
    once = named.filter("rows = 1").select("doc.*")
    again = named.filter("rows > 1").dropDuplicates(["row"]).select("doc.*")
    return once.unionByName(again).unionByName(docs.filter("doc_id is null")).select(*docs.columns)
