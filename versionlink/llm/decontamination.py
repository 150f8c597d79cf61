"""Benchmark decontamination: q-gram lemma filtering, then banded alignment.

Texts are compared after ``normal``: lower case, and every run of ASCII
characters that are neither letters nor digits is one space. An item is covered by
segments of ``SEGMENT`` bytes, ``STEP`` apart and one at its end; a shorter item is one
segment. A segment of m bytes leaks when it occurs with at most
k = m * ``EDIT_PERCENT`` / 100 edits. Where no such segment is found, longer ones, of
the least lengths that allow one edit more each (``LENGTHS``), are tried at the same steps.

So every part of an item of p >= ``SEGMENT`` + ``STEP`` - 1 = 71 bytes is found if it occurs
with at most 5 % of p - 7 edits, wherever they are: up to 247 bytes a segment of
the length for that many edits lies inside it; of a longer part one of the disjoint
segments of ``SEGMENT`` bytes has at most 3. Whole items of ``LEAST`` bytes or more are found with 5 % edits.

By the q-gram lemma such an occurrence shares m + 1 - (k + 1) q of the segment's
q-grams, all on k + 1 neighbouring diagonals (place in the text minus place in
the item). The index holds each q-gram of an item once; shared q-grams are counted
per text and item in two grids of bands, 2 (k + 1) diagonals wide and shifted
by half, one of which holds them all: first for the widest k, then per length for
the segments. What reaches the bound is verified by an alignment that leaves the
band's diagonals no further than k.

The benchmark is small and is sent to the tasks in parts of ``PART_BYTES`` at most;
a larger one takes a pass over the documents for each part, which is written
before the next part is collected. Texts are read whole
and pass in blocks; nothing is shuffled.

Row cases: null or blank texts and items match nothing, items under ``LEAST``
normalised bytes match exactly, as whole words. Every row is judged alone,
so repeated rows get equal answers. An empty benchmark leaves all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, stored, text_blocks
from versionlink.llm.hashing import BYTE, run_hashes

Q = 12
SEGMENT = 64
STEP = 8
LEAST = 32
EDIT_PERCENT = 5
LENGTHS = (SEGMENT, *range(80, 241, 20))
PART_BYTES = 8 << 20
FILTER_BITS = 22

_KIND = np.arange(256, dtype=np.uint8)
_KIND[:128] = [c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() else 32 for c in range(128)]


def normal(text: bytes) -> np.ndarray:
    """The text's bytes in the form that is compared."""
    if not text.isascii():
        text = text.decode().lower().encode()
    codes = _KIND[np.frombuffer(text, np.uint8)]
    blank = codes == 32
    return codes[~(blank & np.concatenate([[True], blank[:-1]]))] if len(codes) else codes


class Index(NamedTuple):
    """The q-grams of the benchmark's items, sorted by hash, and the short items by their bytes."""

    items: list
    codes: list[bytes]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    needed: np.ndarray
    seen: np.ndarray
    short: dict[bytes, list[int]]


def _grams(codes: np.ndarray) -> np.ndarray:
    starts = np.arange(max(0, len(codes) - Q + 1))
    return run_hashes(BYTE[codes], starts, starts + Q)


def allowed(length: int) -> int:
    """Edits in a segment, fewer where the lemma would ask for no q-gram."""
    edits = length * EDIT_PERCENT // 100
    while edits and length + 1 - (edits + 1) * Q < 1:
        edits -= 1
    return edits


def _needed(length: int) -> int:
    return length + 1 - (allowed(length) + 1) * Q


def index(items: list[tuple]) -> Index:
    """``items``: (id, text) pairs; their q-grams."""
    kept, short, needed = [], {}, np.zeros(len(items), np.int64)
    grams, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for k, (_, text) in enumerate(items):
        codes = normal((text or "").encode())
        if len(codes) and codes[-1] == 32:
            codes = codes[:-1]
        kept.append(codes.tobytes())
        if len(codes) < LEAST:
            if len(codes):
                short.setdefault(kept[-1], []).append(k)
            continue
        found = _grams(codes)
        grams.append(found)
        item.append(np.full(len(found), k, np.int32))
        place.append(np.arange(len(found), dtype=np.int32))
        needed[k] = _needed(min(len(codes), SEGMENT))
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[flat >> np.uint64(64 - FILTER_BITS)] = True
    return Index(items, kept, flat[order], np.concatenate(item)[order], np.concatenate(place)[order], needed, seen, short)


def edits_within(segment: bytes, text: bytes, low: int, high: int, most: int) -> int | None:
    """Least edits that turn ``segment`` into a part of ``text`` on diagonals ``low`` to ``high``; none beyond ``most``."""
    far = most + 1
    before = [0 if 0 <= d <= len(text) else far for d in range(low, high + 1)]
    for i, letter in enumerate(segment, 1):
        now = [far] * len(before)
        for k in range(len(before)):
            j = i + low + k  # letters of the text before this cell
            if not 0 <= j <= len(text):
                continue
            best = before[k] + (text[j - 1] != letter) if j else far
            if k + 1 < len(before):
                best = min(best, before[k + 1] + 1)
            if k and j:
                best = min(best, now[k - 1] + 1)
            now[k] = min(best, far)
        if min(now) > most:
            return None
        before = now
    return min(before)


def _hits(index: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place in ``codes`` and an entry of the index with the same q-gram."""
    grams = _grams(codes)
    may = np.flatnonzero(index.seen[grams >> np.uint64(64 - FILTER_BITS)])
    low = np.searchsorted(index.grams, grams[may], "left")
    count = np.searchsorted(index.grams, grams[may], "right") - low
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return np.repeat(may, count), entry


def _words(index: Index, whole: np.ndarray) -> Iterator[tuple[int, int]]:
    """Place and item of every short item that stands in ``whole`` as whole words."""
    edge = np.concatenate([whole, [0]]) % 32 == 0  # blank, or the zero between texts
    first = np.flatnonzero(~edge[:-1] & np.concatenate([[True], edge[:-2]])) if len(whole) else np.empty(0, np.int64)
    for length in sorted({len(s) for s in index.short}):
        at = first[first + length <= len(whole)]
        at = at[edge[at + length]]
        own = [np.frombuffer(s, np.uint8) for s in index.short if len(s) == length]
        wanted = [run_hashes(BYTE[s], np.zeros(1, np.int64), np.full(1, length)) for s in own]
        for place in at[np.isin(run_hashes(BYTE[whole], at, at + length), np.concatenate(wanted))].tolist():
            for item in index.short.get(whole[place : place + length].tobytes(), ()):
                yield place, item


def _bands(diagonal: np.ndarray, half: int, *groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the two grids: the order by group and band, where each band starts in it, and its lowest diagonal."""
    for shift in (0, half):
        band = (diagonal + shift) // (2 * half)
        order = np.lexsort((band, *groups))
        change = np.diff(band[order]) != 0
        for group in groups:
            change |= np.diff(group[order]) != 0
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        yield order, first, band[order[first]] * 2 * half - shift


def _verified(item: bytes, text: bytes, place: np.ndarray, diagonal: np.ndarray) -> tuple[int, int] | None:
    """How many segments of the shortest length that is found, and the least edits; none if none is found."""
    for m in [n for n in LENGTHS if n <= len(item)] or [len(item)]:
        k, needed = allowed(m), _needed(m)
        last = len(item) - m
        starts = np.array(sorted({*range(0, last, STEP), last}))
        found: dict[int, int] = {}
        for order, first, lows in _bands(diagonal, k + 1):
            ends = np.append(first[1:], len(order))
            for at in np.flatnonzero(ends - first >= needed):
                own = np.sort(place[order[first[at] : ends[at]]])
                count = np.searchsorted(own, starts + (m - Q), "right") - np.searchsorted(own, starts, "left")
                for start in starts[count >= needed].tolist():
                    if found.get(start) == 0:
                        continue
                    segment, low, width = item[start : start + m], int(lows[at]) + start, 2 * (k + 1)
                    near = text[max(0, low) : max(0, low + width) + m]
                    edits = 0 if segment in near else edits_within(segment, text, low - k, low + width + k, k)
                    if edits is not None:
                        found[start] = min(edits, found.get(start, edits))
        if found:
            return len(found), min(found.values())
    return None


def find(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """``text, item, segments, edits`` of every leak: which text, which item, how many of its segments."""
    codes = [normal(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])])
    whole = np.full(int(starts[-1]), 0, np.uint8)  # a zero byte, in no q-gram, parts the texts
    for at, c in zip(starts, codes):
        whole[at : at + len(c)] = c
    of = lambda place: np.searchsorted(starts, place, "right") - 1
    found = {(int(of(place)), item): (1, 0) for place, item in _words(index, whole)}
    place, entry = _hits(index, whole)
    if len(place):
        text, item, inside = of(place), index.item[entry].astype(np.int64), index.place[entry].astype(np.int64)
        diagonal = place - starts[text] - inside
        pair = text * len(index.items) + item
        near = set()
        for order, first, _ in _bands(diagonal, allowed(LENGTHS[-1]) + 1, pair):
            size = np.diff(np.append(first, len(order)))
            near.update(pair[order[first[size >= index.needed[item[order[first]]]]]].tolist())
        if near:
            kept = np.flatnonzero(np.isin(pair, np.array(sorted(near))))
            kept = kept[np.argsort(pair[kept], kind="stable")]
            for own in np.split(kept, np.flatnonzero(np.diff(pair[kept])) + 1):
                t, k = int(text[own[0]]), int(item[own[0]])
                best = _verified(index.codes[k], codes[t].tobytes(), inside[own], diagonal[own])
                if best is not None:
                    found[t, k] = best
    for (t, k), (segments, edits) in sorted(found.items()):
        yield t, k, segments, edits


def _parts(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of bounded size that cover the benchmark together, and whether there are several."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + 2 * size // PART_BYTES if size > PART_BYTES else 1
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        yield index([tuple(r) for r in own.sort("item_id", "text").collect()]), parts > 1


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_segments, edits``: the leaks only, a row per document row and item."""
    small_batches(docs.sparkSession)

    def scan(part: Index):
        def run(batches):
            for batch, texts in text_blocks(batches):
                rows = list(find(part, texts))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([part.items[r[1]][0] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                    ["doc_id", "item_id", "n_segments", "edits"],
                )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            run, "doc_id long, item_id long, n_segments long, edits long"
        )

    found = None
    for part, several in _parts(benchmark):
        own = stored(scan(part)) if several else scan(part)
        found = own if found is None else found.unionByName(own)
        del part  # its scan is written, so only one index is held
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no benchmark passage is found, with all their columns."""
    small_batches(docs.sparkSession)

    def scan(rows: DataFrame, part: Index) -> DataFrame:
        def run(batches):
            for batch, texts in text_blocks(batches):
                keep = np.ones(len(texts), bool)
                keep[[r[0] for r in find(part, texts)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    for part, several in _parts(benchmark):
        docs = stored(scan(docs, part)) if several else scan(docs, part)
        del part
    return docs
