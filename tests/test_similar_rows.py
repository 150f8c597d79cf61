"""Similar texts of whole blocks against all pairs, without the gram filter."""

import random

import pytest

from plain_lines import similarity
from versionlink.functions.edits import edit_distance
from versionlink.operators import closest as cl


def sides():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "é"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(25)]
    change = lambda t: t[: rng.randrange(len(t) + 1)] + rng.choice(["", "x", "ab"]) + t[rng.randrange(len(t) + 1):] if rng.random() < 0.3 else t + rng.choice(["", "", "s", " x1"])
    rows = lambda: [(rng.choice([1, 2, 3]), k, change(rng.choice(base))) for k in range(60)]
    odd = [(None, 90, "alpha"), (1, 91, None), (2, 92, ""), (2, 93, ""), (1, None, "beta beta")]
    return [*rows(), *odd, (7, 94, "left only")], [*rows(), *odd, (8, 95, "right only")]


@pytest.mark.parametrize("whole", [True, False])
def test_pairs_and_rows(spark, monkeypatch, whole):
    if whole:
        monkeypatch.setattr(cl, "_similar_by_grams", None)  # no block may go there
    left, right = sides()
    frames = [spark.createDataFrame(rows, f"b long, {c}_at long, {c} string") for rows, c in ((left, "l"), (right, "r"))]
    near = {(b, x, y): similarity(x, y) for b, _, x in left for c, _, y in right
            if b is not None and b == c and None not in (x, y) and similarity(x, y) >= 0.9}
    small = cl.SMALL_BLOCK if whole else 0
    got = cl.similar_pairs(*frames, ["b"], "l", "r", 0.9, small).collect()
    assert {tuple(r) for r in got} == {(*k, s) for k, s in near.items()} and len(got) == len(near) > 20
    best = lambda side: {(k[0], k[side]): max(s for m, s in near.items() if (m[0], m[side]) == (k[0], k[side])) for k in near}
    best_l, best_r = best(1), best(2)
    want = sorted(((b, i, j, near[b, x, y]) for b, i, x in left for c, j, y in right if b == c and (b, x, y) in near
                   and near[b, x, y] in (best_l[b, x], best_r[b, y])), key=repr)
    got = cl.similar_rows(*frames, ["b"], "l", "r", ["l_at"], ["r_at"], 0.9, small).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_pieces_lose_no_text():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    for _ in range(2000):
        a, most = word(rng.randrange(20, 60)), rng.randrange(4)
        b = list(a)
        for _ in range(rng.randrange(most + 2)):
            at = rng.randrange(len(b))
            b[at:at + rng.randrange(2)] = word(rng.randrange(2))
        b = "".join(b)
        d = edit_distance(a, b)
        assert edit_distance(a, b, most) in ((d,) if d <= most else (None, d))
