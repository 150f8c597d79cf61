"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Vectors of integers are packed in blocks. In a block every component has a list of the
vectors sorted by it. A query reads the lists of its own components side by side, from the
top where its component is positive and from the bottom where it is negative, so
contributions only fall. After each stretch every vector has two bounds: what was read
of it plus the least (lower) or the last read value (upper) of the lists in
which it was not met. Vectors whose upper bound is under the k-th best score known stand
outside; reading stops when no more than ``RESOLVE`` others are left, nothing unread
among them, and their final scores are resolved. The k-th best score goes on to the
query's next blocks, which then stop early. Scores, ties included, are exact.

Blocks and queries meet in cells: every pack of queries goes to every lane of blocks
and every lane to every chunk of queries, so a task holds ``LANE`` vectors and ``CHUNK`` queries;
each cell sends k rows a query on. The work grows with queries times vectors, as the
search asks for all of them, but no table holds a pair that is not among a cell's best.

Row cases: null vectors, and those with a null or non-finite component, take no part, nor
do rows without an id. Vectors of other lengths are compared as if filled up with zeros;
an empty vector scores 0. A query's candidates are all rows of another id, repeated rows each
on their own; of several query rows of one id the least vector asks. Equal scores go by
the smaller id. Numbers too large for doubles are counted in Python's integers and
scores end at the range of a long. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, stored

K = 5
PACK = 4096
PACK_VALUES = 1 << 19
LANE = 16_384
CHUNK = 4_096
RESOLVE = 64
# Depths, as shares of a list, after which the bounds are looked at.
DEPTHS = (1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)
EXACT = 1 << 53
LONG = (1 << 63) - 1


def integers(rows: DataFrame, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, vector`` with components ``floor(scale * x)``; rows that take no part are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return rows.filter(F.col(vec_id).isNotNull() & x.isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("vector"),
    )


def _packs(rows: DataFrame) -> DataFrame:
    """``pack, n, width, ids, matrix``: up to ``PACK`` vectors of one length as two byte strings."""

    def packed(ids: list, vectors: list) -> tuple:
        matrix = np.array(vectors, np.int64).reshape(len(ids), -1)
        return len(ids), matrix.shape[1], np.array(ids, np.int64).tobytes(), matrix.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "width", "ids", "matrix"]
        open_packs: dict[int, tuple[list, list]] = {}
        out = lambda done: pa.RecordBatch.from_arrays([pa.array([v]) for v in packed(*done)], names)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for key, at, to in zip(ids, bounds[:-1], bounds[1:]):
                held = open_packs.setdefault(int(to - at), ([], []))
                held[0].append(key)
                held[1].append(flat[at:to])
                if len(held[0]) >= min(PACK, max(1, PACK_VALUES // max(1, to - at))):
                    yield out(open_packs.pop(int(to - at)))
        for held in open_packs.values():
            yield out(held)

    small_batches(rows.sparkSession)
    packs = rows.select("vec_id", "vector").mapInArrow(run, "n long, width long, ids binary, matrix binary")
    return packs.withColumn("pack", F.xxhash64(F.lit("pack"), "ids", F.monotonically_increasing_id()))


class Lists:
    """The sorted lists of a block of vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.order = np.argsort(matrix.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(matrix.T, self.order, axis=1)
        self.seen = np.zeros(matrix.shape)

    def read(self, side: np.ndarray, at: int, to: int, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and values at the places ``at`` to ``to`` of the lists ``side``, from the top if ``up``."""
        n = len(self.ids)
        part = slice(n - to, n - at) if up else slice(at, to)
        return self.order[side, part], self.sorted[side, part]

    def best(self, query: np.ndarray, k: int, least, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors but those of id ``own`` that may be among the best ``k``.

        ``least`` is the k-th best score known from other blocks, or None.
        """
        n = len(self.ids)
        others = self.ids != own
        exact = query.dtype != object and self.matrix.dtype != object
        total = np.zeros(n, float if exact else object)
        sides = [(np.flatnonzero(query > 0), True), (np.flatnonzero(query < 0), False)]
        floor = np.zeros(len(query), total.dtype)
        for side, up in sides:
            floor[side] = query[side] * self.sorted[side, 0 if up else -1]
        seen, at = self.seen, 0
        seen[:] = 0
        for share in DEPTHS:
            to = max(min(n, at + 1), int(n * share)) if share < 1 else n
            last = np.zeros(len(query), total.dtype)
            for side, up in sides:
                if not len(side):
                    continue
                if to > at:
                    met, values = self.read(side, at, to, up)
                    gained = values * query[side][:, None]
                    if exact:
                        total += np.bincount(met.ravel(), gained.ravel(), n)
                    else:
                        np.add.at(total, met.ravel(), gained.ravel())
                    seen[met, side[:, None]] = 1
                last[side] = query[side] * self.sorted[side, n - to if up else to - 1]
            at = to
            # what the lists still hold for a vector that was not met in them
            rest = 1 - seen if not exact else None
            if exact:
                lower = total + floor.sum() - seen @ floor
                upper = total + last.sum() - seen @ last
            else:
                rest = rest.astype(int).astype(object)
                lower, upper = total + rest @ floor, total + rest @ last
            known = lower[others]
            bound = least
            if len(known) >= k:
                kth = np.partition(known, len(known) - k)[len(known) - k]
                bound = kth if bound is None else max(bound, kth)
            inside = others if bound is None else others & (upper >= bound)
            places = np.flatnonzero(inside)
            if len(places) <= RESOLVE or at == n:
                break
        return places, self.matrix[places] @ query


def _vectors(row, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    matrix = np.frombuffer(row.matrix, np.int64).reshape(len(ids), int(row.width))
    if width is not None and matrix.shape[1] != width:
        fitted = np.zeros((len(ids), width), np.int64)
        shared = min(width, matrix.shape[1])
        fitted[:, :shared] = matrix[:, :shared]
        matrix = fitted
    return ids, matrix


def _largest(matrix: np.ndarray) -> int:
    return max(int(matrix.max()), -int(matrix.min())) if matrix.size else 0


def search_cell(cell: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` rows of a cell for each of its queries."""
    blocks, packs = cell[~cell["asks"]], cell[cell["asks"]]
    best: dict[int, list[tuple[int, int]]] = {}
    for block in blocks.sort_values("pack").itertuples():
        ids, matrix = _vectors(block)
        width, top, lists = matrix.shape[1], _largest(matrix), {}
        for pack in packs.itertuples():
            query_ids, queries = _vectors(pack, width)
            exact = top * _largest(queries) * max(1, width) < EXACT
            if exact not in lists:
                lists[exact] = Lists(ids, matrix.astype(float if exact else object))
            queries = queries.astype(float if exact else object)
            for own, query in zip(query_ids.tolist(), queries):
                held = best.setdefault(own, [])
                least = -held[-1][0] if len(held) == k else None
                places, scores = lists[exact].best(query, k, least, own)
                held.extend((-int(s), int(i)) for s, i in zip(scores, ids[places]))
                held.sort()
                del held[k:]
    rows = [(own, i, max(-LONG - 1, min(LONG, -s))) for own, held in best.items() for s, i in held]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Per query ``query_id, rank, vec_id, score`` of the ``k`` best of ``vectors`` (``vec_id, vector``)."""
    asking = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks, packs = stored(_packs(vectors)), stored(_packs(asking))
    count = lambda packed, size: max(1, -(-(packed.agg(F.sum("n")).first()[0] or 0) // size))
    lanes, chunks = count(blocks, LANE), count(packs, CHUNK)
    place = lambda parts: F.pmod("pack", F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cells = blocks.withColumns({"asks": F.lit(False), "lane": place(lanes)}).withColumn("chunk", every(chunks)).unionByName(
        packs.withColumns({"asks": F.lit(True), "chunk": place(chunks)}).withColumn("lane", every(lanes))
    )
    found = cells.groupBy("lane", "chunk").applyInPandas(
        lambda cell: search_cell(cell, k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
