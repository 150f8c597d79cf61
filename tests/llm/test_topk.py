"""Top-k search over sorted lists against all inner products."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from versionlink.llm import topk


def brute(rows, k=5, modulo=50):
    own = []
    for key, v in rows:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((key, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v]))
    asks = {}
    for key, v in own:
        if key % modulo == 0:
            asks[key] = min(asks.get(key, v), v)
    out = []
    for key, q in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in own if i != key)[:k]
        out += [(key, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, embedding array<double>, pack int, score string")
    vectors = topk.integers(df.repartition(5))
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect())


@pytest.mark.parametrize("lane", [16_384, 40])
def test_search(spark, monkeypatch, lane):
    monkeypatch.setattr(topk, "PACK", 30)
    monkeypatch.setattr(topk, "LANE", lane)
    monkeypatch.setattr(topk, "CHUNK", lane)
    monkeypatch.setattr(topk, "RESOLVE", 4)
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)]) for k in range(400)]
    rows += [(k, [rng.choice([0.0, 0.5]) for _ in range(8)]) for k in range(400, 460)]  # many ties
    rows += [rows[7], rows[50], rows[50], (50, [2.0] * 8), (None, [9.0] * 8), (470, None), (471, []), (550, [])]
    rows += [(472, [1.0, None]), (473, [float("nan")] * 8), (474, [float("inf")] * 8), (475, [1.0] * 3), (600, [0.0] * 8), (650, [1.0] * 20)]
    assert search(spark, rows) == brute(rows)


def test_large_numbers_few_rows_and_none(spark):
    rows = [(0, [1e17, 1.0, -3.0]), (1, [1e13, 0.01, 0.0]), (2, [1e13, 0.02, 1.0]), (3, [-1e300, 0.0, 1e300])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []


def test_reading_stops_early():
    """A query whose best rows are clear reads the heads of the lists only."""
    rng = np.random.default_rng(1)
    matrix = np.floor(rng.normal(0, 20, (2000, 16)))
    matrix[:8] = 400
    lists, read = topk.Lists(np.arange(2000), matrix), []
    plain = lists.read
    lists.read = lambda side, at, to, up: read.append(to) or plain(side, at, to, up)
    places, scores = lists.best(np.full(16, 9.0), 5, None, -1)
    assert set(range(8)) <= set(places.tolist()) and max(read) <= 125 and len(places) <= topk.RESOLVE
    assert (scores == matrix[places] @ np.full(16, 9.0)).all()


def test_cell_carries_the_best_score():
    rng = np.random.default_rng(2)
    def pack(asks, key, ids, matrix):
        return (asks, key, len(ids), matrix.shape[1], np.array(ids, np.int64).tobytes(), matrix.astype(np.int64).tobytes())
    matrix = rng.integers(-99, 99, (600, 12))
    rows = [pack(False, k, range(200 * k, 200 * k + 200), matrix[200 * k : 200 * k + 200]) for k in range(3)]
    rows.append(pack(True, 9, [3, 700], np.stack([matrix[3], -matrix[5]])))
    cell = pd.DataFrame(rows, columns=["asks", "pack", "n", "width", "ids", "matrix"])
    got = topk.search_cell(cell, 5)
    for own, q in ((3, matrix[3]), (700, -matrix[5])):
        want = sorted((-int(v @ q), i) for i, v in enumerate(matrix) if i != own)[:5]
        assert [(-s, i) for i, s in got[got.query_id == own][["vec_id", "score"]].values.tolist()] == want
