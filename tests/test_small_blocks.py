"""Blocks of a few short texts are compared in one row, with the results of the tiles."""

import random

import pytest

from versionlink.operators import closest as module


def test_rows_give_what_tiles_give(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 4)))
    side = lambda c: spark.createDataFrame([(rng.randrange(20) if k % 9 else None, text()) for k in range(120)], f"b int, {c} string").localCheckpoint()
    left, right = side("l"), side("r")
    rows = lambda *asks: sorted(map(tuple, module.closest(left, right, ["b"], "l", "r", *asks).collect()))
    found = {}
    for limit in (0, 20, 64):  # all in tiles, some, all in rows
        monkeypatch.setattr(module, "ROW_PAIRS", limit)
        found[limit] = [rows(*asks) for asks in ((True, True), (True, False), (False, True))]
    assert found[0] == found[20] == found[64] and len(found[0][0]) > 50


def test_small_blocks_need_no_search(spark, monkeypatch):
    monkeypatch.setattr(module, "weighed_tiles", lambda *_: pytest.fail("a search in tiles"))
    left, right = spark.createDataFrame([(1, "mov"), (1, "jmp")], "b int, l string"), spark.createDataFrame([(1, "movl")], "b int, r string")
    found = module.closest(left, right, ["b"], "l", "r").collect()
    assert sorted(map(tuple, found)) == [(1, "jmp", "movl", 0.0, True, False), (1, "mov", "movl", 0.75, True, True)]
