"""Weight of the words that two lines of a block share, over whole blocks.

The k-th occurrence of a word in one line meets the k-th in the other. Blocks are cut into tiles
by the size of their lines, and a task counts the words of its tiles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from versionlink.operators.pairing import weighed_tiles

# What a line counts besides its letters, so that a tile of very short lines has boundedly many pairs.
LINE_WEIGHT = 64
# Product of the weights of the two sides of a tile.
TILE_WORK = 1 << 28
CODES, PLACES = ["old_code", "new_code"], ["old_at", "new_at"]


def _numbered(texts: list[str]) -> list[dict[str, int]]:
    """Per text its words with the numbers of their occurrences, as bits; texts of one line count together."""
    if len(texts) == 1:
        found: dict[str, int] = {}
        for word in texts[0].split(" "):
            found[word] = found.get(word, 0) << 1 | 1
        return [found]
    seen: dict[str, int] = defaultdict(int)
    places = sorted((at, k, word) for k, text in enumerate(texts) for at, word in enumerate(text.split(" ")))
    out: list[dict[str, int]] = [{} for _ in texts]
    for _, k, word in places:
        out[k][word] = out[k].get(word, 0) | 1 << seen[word]
        seen[word] += 1
    return out


class _Lines:
    """One side of a tile: a row for each code of a line, with its words."""

    def __init__(self, rows: list[tuple[int, list[str], list[str]]]):
        self.line: list[int] = []
        self.code: list[str] = []
        self.at: list[int] = []
        self.words: list[dict[str, int]] = []
        for line, codes, texts in rows:
            own: dict[str, dict[str, int]] = {}
            for code, words in zip(codes, _numbered(texts)):
                held = own.setdefault(code, {})
                for word, bits in words.items():
                    held[word] = held.get(word, 0) | bits
            for at, (code, words) in enumerate(own.items()):
                self.line.append(line)
                self.code.append(code)
                self.at.append(at)
                self.words.append(words)


def _pairs(old: _Lines, new: _Lines):
    """Rows of both sides that share a word, with the summed length of what they share."""
    held: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for n, words in enumerate(new.words):
        for word, bits in words.items():
            held[word].append((n, bits))
    for o, words in enumerate(old.words):
        weight: dict[int, int] = {}
        for word, bits in words.items():
            size = len(word)
            for n, others in held.get(word, ()):
                both = bits & others
                if both:
                    weight[n] = weight.get(n, 0) + size * both.bit_count()
        for n, total in weight.items():
            yield o, n, total


def _weigh_bucket(codes: bool):
    def weigh(table: pa.Table) -> pa.Table:
        tiles: dict[tuple, tuple[list, list]] = {}
        paths: dict[tuple, tuple[str, str]] = {}
        columns = [table.column(c).to_pylist() for c in ("__tile", "__old", "line", "codes", "words", "__old_path", "__new_path")]
        for tile, is_old, line, texts, words, *ends in zip(*columns):
            tile = tuple(tile.values())
            tiles.setdefault(tile, ([], []))[0 if is_old else 1].append((line, texts, words))
            paths[tile] = ends
        found: list[list] = [[] for _ in range(7)]
        for tile, sides in tiles.items():
            old, new = map(_Lines, sides)
            for o, n, total in _pairs(old, new):
                longest = max(len(old.code[o]), len(new.code[n]))
                row = (paths[tile][0], old.line[o], paths[tile][1], new.line[n], total / longest if longest else 0.0)
                shown = (old.code[o], new.code[n]) if codes else (old.at[o], new.at[n])
                for column, value in zip(found, (*row, *shown)):
                    column.append(value)
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), *[pa.string() if codes else pa.int64()] * 2]
        names = ["old_path", "old_line", "new_path", "new_line", "len", *(CODES if codes else PLACES)]
        return pa.table([pa.array(c, t) for c, t in zip(found, types)], names=names)

    return weigh


def word_weights(old: DataFrame, new: DataFrame, block: list[str], plain: Callable[[Column], Column], codes: bool) -> DataFrame:
    """Line pairs of a block that share a word, with the share as ``len`` (length of shared words by longer code).

    Rows have both ``codes``, or else the place of each among the sorted different codes of its line. Both sides have ``block`` (with ``old_path, new_path``), ``line``, ``codes`` (of the rows of a line)
    and ``__weight``. ``plain`` gives the words of a code, one space between them; they are drawn where the codes have been moved to.
    """
    ends = [F.col("old_path").alias("__old_path"), F.col("new_path").alias("__new_path")]
    tiles, tasks = weighed_tiles(old.select("*", *ends), new.select("*", *ends), block, "__weight", TILE_WORK)
    buckets = max(int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    kind, shown = ("string", CODES) if codes else ("bigint", PLACES)
    schema = ", ".join(["old_path string, old_line bigint, new_path string, new_line bigint, len double", *[f"{c} {kind}" for c in shown]])
    bucket = F.pmod(F.xxhash64("__tile"), F.lit(buckets)).alias("bucket")
    moved = tiles.select(bucket, "*").repartition(buckets, "bucket").withColumn("words", F.transform("codes", plain))
    found = moved.groupBy("bucket").applyInArrow(_weigh_bucket(codes), schema)
    return found.select("old_path", "old_line", "new_path", "new_line", *shown, "len")
