"""Closest texts of blocks that one task searches, against all pairs."""

import random

import pytest

from versionlink.functions.edits import edit_distance
from versionlink.operators import closest as cl


def sides(seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
    rows = lambda: [(b, text()) for b in range(6) for _ in range(rng.randrange(0, 12))] + [(None, "x"), (9, None), (1, "both"), (1, "both"), (2, "é" * 40)]
    return [*rows(), (7, "left only")], [*rows(), (8, "right only")]


def expected(left, right, for_left, for_right):
    out = {}
    for b in {b for b, _ in left} - {None}:
        ls, rs = ({t for k, t in side if k == b and t is not None} for side in (left, right))
        score = {(a, c): 1.0 - edit_distance(a, c) / max(len(a), len(c), 1) for a in ls for c in rs}
        for (a, c), s in score.items():
            best_l = for_left and (a == c or s == max(score[a, x] for x in rs))
            best_r = for_right and (a == c or s == max(score[x, c] for x in ls))
            if best_l or best_r or a == c:
                out[b, a, c] = (round(s, 12), best_l, best_r)
    return out


@pytest.mark.parametrize("for_left,for_right", [(True, True), (True, False), (False, True)])
def test_blocks_in_tasks(spark, monkeypatch, for_left, for_right):
    monkeypatch.setattr(cl, "ROW_PAIRS", 2)  # nearly all blocks go to tasks
    monkeypatch.setattr(cl, "_in_tiles", None)  # and none is cut into tiles
    left, right = sides(2)
    frame = lambda rows, c: spark.createDataFrame(rows, f"b long, {c} string")
    got = cl.closest(frame(left, "l"), frame(right, "r"), ["b"], "l", "r", for_left, for_right).collect()
    want = expected(left, right, for_left, for_right)
    assert len(got) == len(want) > 5
    assert {(r.b, r.l, r.r): (round(r.similarity, 12), r.best_left, r.best_right) for r in got} == want
