"""Importance resampling towards the distribution of a target, by exact selection.

Weights: features are runs of up to ``longest`` words of a text, hashed into
``buckets``. Two arrays count the buckets in the corpus and in the target; a bucket's
gain is the floored thousandfold logarithm of the smoothed ratio of its shares, and a
document weighs the floored mean of its features' gains. The array of gains has one
number a bucket whatever the corpus, so tasks carry it. Gumbel noise from a hash of the
id is added, which makes the best ``percent`` of the documents a sample without
replacement in proportion to the weights.

Selection: the cutoff key is found without sorting all documents. Every part of
up to ``PART_KEYS`` open keys gives its median and its size; the median of these medians,
weighted by size, is the next pivot, and the same pass that counts the keys around it gives
the medians of both sides. At least about a quarter of the open keys lie on each side
of it, so every pass discards that share for certain, mostly a half. The driver sees a median
a part. Keys that are still open are written anew when they fell to an
eighth, and once ``FINISH`` or fewer are open they are ordered at once. Only the drawn
rows are sorted: by range, numbered in each range, and offset by the ranges before.

Row cases: a null or empty text has no features, weight 0, and is no candidate. Null
ids hash as ``null`` and come last among equal scores. Rows of equal score and id are
told apart by a hash of the text; rows equal in that too are interchangeable, and as many of them
as fit are drawn. An empty corpus gives no rows, an empty target smoothed counts. A
document's own columns stay in the struct ``row``, so their names clash with nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from versionlink.llm.common import small_batches, stored, text_blocks
from versionlink.llm.tokens import Runs

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PART_KEYS = 1_000_000
FINISH = 10_000
LAST = (1 << 63) - 1

# Bytes of words once A to Z are lowered: digits, letters, and all beyond ASCII.
_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


class Key(NamedTuple):
    """Order of documents: falling score, then rising id, then a hash of the text."""

    fall: int
    id: int
    tie: int


def _features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature, text by text, and each text's number of features."""
    runs = Runs(texts, lambda data: _WORD[data])
    of_word = np.array([zlib.crc32(w) % buckets for w in runs.distinct], np.int64)
    if longest == 1:
        return of_word[runs.code] if len(runs.code) else np.zeros(0, np.int64), runs.counts
    found, counts = [], []
    for first, end in zip(runs.first[:-1], runs.first[1:]):
        words = [runs.distinct[c] for c in runs.code[first:end]]
        own = [
            zlib.crc32(b" ".join(words[at : at + n])) % buckets
            for n in range(1, longest + 1) for at in range(len(words) - n + 1)
        ]
        found.extend(own)
        counts.append(len(own))
    return np.array(found, np.int64), np.array(counts, np.int64)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all ``text`` fall into each bucket; every task sends one sum a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, block in text_blocks(batches):
            total += np.bincount(_features(block, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    sums = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([
        math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))))
        for a, b in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``keep``, or of all columns), ``id, tie, n_features, weight``."""
    buckets = len(gain)
    rows = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.lit("tie"), "text").alias("tie"), F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            found, counts = _features(block, longest, buckets)
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(counts)
            sums = upto[ends] - upto[ends - counts]
            weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "id", "tie")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(counts.astype(np.int64)), pa.array(weight.astype(np.int64))],
                ["row", "id", "tie", "n_features", "weight"],
            )

    small_batches(docs.sparkSession)
    longs = [StructField(c, LongType()) for c in ("id", "tie", "n_features", "weight")]
    return rows.mapInArrow(run, StructType([rows.schema["row"], *longs]))


def noise(seed: int = SEED):
    """Floored thousandfold Gumbel noise from the hash of seed and ``id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _before(keys: np.ndarray, pivot: Key) -> np.ndarray:
    a, b, c = keys
    return (a < pivot.fall) | ((a == pivot.fall) & ((b < pivot.id) | ((b == pivot.id) & (c < pivot.tie))))


def _median(keys: np.ndarray) -> list[int | None]:
    count = keys.shape[1]
    if count == 0:
        return [None, None, None]
    at = np.lexsort(keys[::-1])[(count - 1) // 2]
    return [int(x) for x in keys[:, at]]


def _pass(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list:
    """Per part of the open keys: how many lie before, at and after the pivot, and the medians of both sides."""

    def split(held: list[np.ndarray]) -> pd.DataFrame:
        own = np.concatenate(held, axis=1)
        before = _before(own, pivot) if pivot else np.zeros(own.shape[1], bool)
        same = (own == np.array(pivot)[:, None]).all(axis=0) if pivot else np.zeros(own.shape[1], bool)
        after = ~before & ~same
        return pd.DataFrame([[
            int(before.sum()), int(same.sum()), int(after.sum()), *_median(own[:, before]), *_median(own[:, after])
        ]], columns=names).astype("Int64")

    names = ["before", "same", "after", "b_fall", "b_id", "b_tie", "a_fall", "a_id", "a_tie"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            own = np.stack([pdf[c].to_numpy(np.int64) for c in Key._fields])
            if low:
                own = own[:, ~_before(own, low) & ~(own == np.array(low)[:, None]).all(axis=0)]
            if high:
                own = own[:, _before(own, high)]
            if own.shape[1]:
                held.append(own)
                n += own.shape[1]
            if n >= PART_KEYS:
                yield split(held)
                held, n = [], 0
        if held:
            yield split(held)

    return _between(keys, low, high).mapInPandas(run, ", ".join(f"{c} long" for c in names)).collect()


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    """Rows that may be open, by the part of the key that the written table can prune."""
    if low:
        keys = keys.filter(F.col("fall") >= low.fall)
    return keys.filter(F.col("fall") <= high.fall) if high else keys


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    half, upto = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        upto += n
        if upto >= half:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, wanted: int) -> Key:
    """The ``wanted``-th key (from 1) of the table ``fall, id, tie``, by weighted medians of medians."""
    low = high = pivot = None
    held = None
    while True:
        parts = _pass(keys, low, high, pivot)
        before, same = sum(p["before"] for p in parts), sum(p["same"] for p in parts)
        if pivot and before < wanted <= before + same:
            return pivot
        if pivot is None or wanted > before + same:
            side, left, wanted = "a", sum(p["after"] for p in parts), wanted - before - same
            low = pivot or low
        else:
            side, left, high = "b", before, pivot
        if left < wanted:
            raise ValueError("fewer keys than wanted")
        sizes = {"a": "after", "b": "before"}[side]
        medians = [(Key(p[f"{side}_fall"], p[f"{side}_id"], p[f"{side}_tie"]), p[sizes]) for p in parts if p[sizes]]
        if left <= FINISH:
            return _open(keys, low, high)[wanted - 1]
        held = left if held is None else held
        if left * 8 <= held:
            keys, held = stored(_exactly(keys, low, high)), left
        pivot = _weighted_median(medians)


def _exactly(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    at = F.struct(*Key._fields)
    bound = lambda key: F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(Key._fields, key)])
    if low:
        keys = keys.filter(at > bound(low))
    return keys.filter(at < bound(high)) if high else keys


def _open(keys: DataFrame, low: Key | None, high: Key | None) -> list[Key]:
    """The open keys in order, ``FINISH`` at most."""
    return sorted(Key(*r) for r in _exactly(keys, low, high).select(*Key._fields).collect())


def _numbered(rows: DataFrame, count: int) -> DataFrame:
    """``rank`` (from 1) in the order of the key: sorted ranges, each offset by the ranges before it."""
    parts = max(1, -(-count // PART_KEYS))
    ordered = rows.repartitionByRange(parts, *Key._fields).sortWithinPartitions(*Key._fields)
    names = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at + 1, at + n + 1))],
                [*names, "part", "place"],
            )
            at += n

    longs = [StructField(c, LongType()) for c in ("part", "place")]
    placed = stored(ordered.mapInArrow(run, StructType([*ordered.schema, *longs])))
    sizes = placed.groupBy("part").agg(F.max("place").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part"))  # one row a range
    before = sizes.select("part", (upto - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("place") + F.col("__before")).drop(
        "part", "place", "__before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS,
    longest: int = 1, buckets: int = BUCKETS, keep: list[str] | None = None,
) -> DataFrame:
    """Per document ``row, n_features, weight, score, rank``; the rank is null where it is not drawn.

    ``keep`` names the columns of ``docs`` that ``row`` holds, all by default.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = stored(
        weigh(docs, gain, longest, keep).withColumn("score", F.col("weight") + noise(seed))
        .withColumns({"fall": -F.col("score"), "id": F.coalesce("id", F.lit(LAST))})
    )
    fits = F.col("n_features") >= least_words
    wanted = percent * rows.filter(fits).count() // 100
    out = ["row", "n_features", "weight", "score"]
    if wanted == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = cutoff(rows.filter(fits).select(*Key._fields), wanted)
    drawn = fits & (F.struct(*Key._fields) <= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(Key._fields, last)]))
    winners = _numbered(rows.filter(drawn), wanted)
    rank = F.when(F.col("rank") <= wanted, F.col("rank"))  # more rows may share the last key
    return winners.select(*out, rank.alias("rank")).unionByName(
        rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
