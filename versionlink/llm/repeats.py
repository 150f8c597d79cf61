"""Substring deduplication with difference-cover anchors.

A window is ``LENGTH`` consecutive words of a document. A word goes when a window over it
also starts earlier: in a smaller id, or earlier in the same document.

1. Anchors. ``COVER`` is a difference cover modulo ``PERIOD``: any difference of two places
   is one of two of its members. Runs of ``LENGTH - PERIOD + 1`` words are hashed only
   where place modulo ``PERIOD`` is in the cover. Two equal windows at any places then
   share an aligned anchor inside, so a window without a repeated anchor is unique.
2. Extension. Only windows around repeated anchors are hashed in full (96 bits),
   and the first place of each hash is found.
3. The later places are removed from the texts.

Both searches sort hashes in buckets, whose number follows the bytes of text. A
task combines what it has before the shuffle: an anchor that repeats inside the
task is settled there and sent once, a window is sent with its first place only. A
passage that a third of all documents share thus reaches its bucket once per task.
Between the steps, places are kept per row as binary lists of 32-bit numbers.

Row cases: null or blank text has no words, its digest is that of empty bytes.
Fewer words than a window are kept. Equal rows (id and text) are one document,
so neither is earlier; rows that share only the id are ordered by their hash. Null ids
come last. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import release, row_key, small_batches, stored, text_blocks
from versionlink.llm.hashing import BASES, Words, run_hashes

LENGTH = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
BUCKET_BYTES = 16 << 20
FLUSH = 2_000_000
LAST = (1 << 63) - 1
_SENT = "bucket long, grams binary, more binary, ids binary, rows binary, spots binary"


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(change)
    return starts, np.diff(np.concatenate([starts, [n]]))


def _by_row(rows: np.ndarray, spots: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort([spots, rows])
    rows, spots = rows[order], spots[order].astype(np.int32)
    for start, length in zip(*_runs(rows)):
        yield int(rows[start]), np.unique(spots[start : start + length]).tobytes()


def _packed(settled, buckets: int, sent: dict[str, np.ndarray] | None) -> pa.RecordBatch:
    """Rows for the shuffle: hashes by bucket, and settled places (no hashes) that only pass through."""
    columns: dict[str, list] = {k: [] for k in ("bucket", "grams", "more", "ids", "rows", "spots")}
    for row, spots in settled:
        for name, value in zip(columns, (row % buckets, None, None, None, np.int64(row).tobytes(), spots)):
            columns[name].append(value)
    if sent is not None:
        bucket = (sent["grams"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        for start, length in zip(*_runs(bucket)):
            own = order[start : start + length]
            columns["bucket"].append(int(bucket[start]))
            for name in ("grams", "more", "ids", "rows", "spots"):
                columns[name].append(sent[name][own].tobytes() if name in sent else None)
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns)
    )


def _anchors(length: int, buckets: int):
    """Hashes at the cover's places, those repeated inside the task settled."""
    size = length - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def flush(held) -> pa.RecordBatch:
        grams, rows, spots = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(grams, kind="stable")
        starts, lengths = _runs(grams[order])
        again = order[np.repeat(lengths > 1, lengths)]
        settled = list(_by_row(rows[again], spots[again]))
        spots[again] = -1  # needs no answer
        first = np.sort(order[starts])  # in text order, which compresses well
        return _packed(settled, buckets, {"grams": grams[first], "rows": rows[first], "spots": spots[first]})

    def run(batches):
        held, count = [], 0
        for batch, texts in text_blocks(batches):
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            words = Words(texts)
            grams = words.windows(words.hashes(), size)
            place = np.arange(len(words.starts)) - np.repeat(words.first[:-1], words.counts)
            whole = place + size <= np.repeat(words.counts, words.counts)
            at = np.flatnonzero(in_cover[place % PERIOD] & whole)
            held.append((grams[at], np.repeat(rows, words.counts)[at], place[at].astype(np.int32)))
            count += len(at)
            if count >= FLUSH:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    return run


def _flat(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table[name]), kind)


def _answers(answer, buckets: int):
    """The rows of one bucket: settled places pass, hashes go to ``answer``; places come out, packed by row."""

    def run(table: pa.Table) -> pa.Table:
        settled, sent = table.filter(table["grams"].is_null()), table.filter(table["grams"].is_valid())
        rows, found = answer(lambda name, kind: _flat(sent, name, kind))
        spots = [np.frombuffer(x.as_py(), np.int32) for x in settled["spots"]]
        rows = np.concatenate([np.repeat(_flat(settled, "rows", np.int64), [len(s) for s in spots]), rows]).astype(np.int64)
        found = np.concatenate([*spots, found]).astype(np.int32)
        to = rows % buckets
        order = np.argsort(to, kind="stable")
        pieces = [(int(to[order[at]]), order[at : at + n]) for at, n in zip(*_runs(to[order]))]
        return pa.table({
            "bucket": pa.array([k for k, _ in pieces], pa.int64()),
            "rows": pa.array([rows[own].tobytes() for _, own in pieces], pa.binary()),
            "spots": pa.array([found[own].tobytes() for _, own in pieces], pa.binary()),
        })

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """One row per document row with all its places."""
    out = list(_by_row(_flat(table, "rows", np.int64), _flat(table, "spots", np.int32)))
    return pa.table({"row": pa.array([r for r, _ in out], pa.int64()), "spots": pa.array([s for _, s in out], pa.binary())})


def _repeated(flat) -> tuple[np.ndarray, np.ndarray]:
    grams, rows, spots = flat("grams", np.uint64), flat("rows", np.int64), flat("spots", np.int32)
    order = np.argsort(grams, kind="stable")
    lengths = _runs(grams[order])[1]
    wanted = order[np.repeat(lengths > 1, lengths)]
    wanted = wanted[spots[wanted] >= 0]
    return rows[wanted], spots[wanted]


def _later(grams, more, ids, rows, spots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window and place; in it, the first places and those after a smaller one."""
    order = np.lexsort([spots, rows, ids, more, grams])
    starts, lengths = _runs(grams[order], more[order])
    first = np.repeat(order[starts], lengths)
    later = (ids[order] != ids[first]) | (rows[order] != rows[first]) | (spots[order] != spots[first])
    return order, starts, later


def _not_first(flat) -> tuple[np.ndarray, np.ndarray]:
    columns = [flat(*c) for c in (("grams", np.uint64), ("more", np.uint32), ("ids", np.int64),
                                  ("rows", np.int64), ("spots", np.int32))]
    order, _, later = _later(*columns)
    return columns[3][order[later]], columns[4][order[later]]


def _marked(spots: bytes, n: int, before: int, length: int) -> np.ndarray:
    """Which of ``n`` places lie in ``[spot - before, spot - before + length)`` of a spot."""
    edge = np.zeros(n + 1, np.int64)
    at = np.frombuffer(spots, np.int32).astype(np.int64) - before
    np.add.at(edge, np.clip(at, 0, n), 1)
    np.add.at(edge, np.clip(at + length, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(length: int, buckets: int):
    """Hashes of the windows around repeated anchors, first places only; later ones are settled."""
    size = length - PERIOD + 1

    def flush(held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        order, starts, later = _later(*columns)
        names = ("grams", "more", "ids", "rows", "spots")
        first = np.sort(order[starts])
        sent = {k: c[first] for k, c in zip(names, columns)}
        return _packed(_by_row(columns[3][order[later]], columns[4][order[later]]), buckets, sent)

    def run(batches):
        held, count = [], 0
        for batch, texts in text_blocks(batches):
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).fill_null(LAST).to_numpy(zero_copy_only=False)
            words = Words(texts)
            hashes = words.hashes()
            for k, spots in enumerate(batch.column(3).to_pylist()):
                n = int(words.counts[k]) - length + 1
                if n < 1:
                    continue
                at = np.flatnonzero(_marked(spots, n, length - size, length - size + 1))
                own = hashes[words.of(k)]
                grams = run_hashes(own, at, at + length)
                more = (run_hashes(own, at, at + length, BASES[1]) >> np.uint64(32)).astype(np.uint32)
                held.append((grams, more, np.full(len(at), ids[k]), np.full(len(at), rows[k]), at.astype(np.int32)))
                count += len(at)
            if count >= FLUSH:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    return run


def _cleaned(length: int):
    def run(batches):
        for batch, texts in text_blocks(batches):
            totals, gone, digests, kept = [], [], [], []
            for text, spots in zip(texts, batch.column(3).to_pylist()):
                words = text.split()
                removed = 0
                if spots and words:
                    out = _marked(spots, len(words), 0, length)
                    removed = int(np.count_nonzero(out))
                    stay = [w for w, o in zip(words, out.tolist()) if not o]
                else:
                    stay = words
                joined = b" ".join(stay)
                totals.append(len(words))
                gone.append(removed)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests),
                 pa.array([t.decode() for t in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (kept words joined by one space)."""
    small_batches(docs.sparkSession)
    if length <= PERIOD:
        raise ValueError(f"windows must be longer than the period {PERIOD}")
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // bucket_bytes

    def places(made: DataFrame, answer) -> DataFrame:
        packed = made.groupBy("bucket").applyInArrow(_answers(answer, buckets), "bucket long, rows binary, spots binary")
        return stored(packed.groupBy("bucket").applyInArrow(_gathered, "row long, spots binary"))

    anchors = places(rows.select("row", "text").mapInArrow(_anchors(length, buckets), _SENT), _repeated)
    around = rows.join(anchors, "row").select("row", "doc_id", "text", "spots")
    later = places(around.mapInArrow(_windows(length, buckets), _SENT), _not_first)
    release(docs.sparkSession)
    return rows.join(later, "row", "left").select("row", "doc_id", "text", "spots").mapInArrow(
        _cleaned(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
