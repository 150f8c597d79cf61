"""Blocks of many classes, linked as a matrix, against the rounds on single pairs."""

import random

import numpy as np
import pytest

from versionlink.operators import ordered
from versionlink.plans import project


def test_matrix_rounds():
    rng = random.Random(3)
    for _ in range(200):
        side = lambda first: {c: [(f"f{rng.randrange(9)}", first + 100 * c + 2 * i) for i in range(rng.randint(1, 5))] for c in range(rng.randint(1, 12))}
        old, new = side(0), side(1)
        pairs = {(a, b): rng.randrange(4) for a in old for b in new if rng.random() < 0.9} or {(0, 0): 1}
        copy = lambda rows: {k: list(v) for k, v in rows.items()}
        want = sorted(ordered._block_links(dict(pairs), copy(old), copy(new)))
        a, b = (np.array([k[at] for k in pairs]) for at in (0, 1))
        assert sorted(ordered._matrix_links(a, b, np.array(list(pairs.values())), copy(old), copy(new))) == want


def test_rows_of_one_name_never_go_by_joins(spark, monkeypatch):
    """Functions of one name each need no rounds of joins, also where the caller allows several."""
    monkeypatch.setattr(ordered, "_mutual", lambda *_: pytest.fail("a round of joins"))
    side = lambda first: spark.createDataFrame(
        [(first + 2 * i, f"f{i % 7}", "file", 1) for i in range(200)], "fid long, func string, file string, blocks int")
    links = project.nearest_calls_in_file(side(0), side(1)).collect()
    assert len(links) == 200 and sum(r.old_func == r.new_func for r in links) == 200
