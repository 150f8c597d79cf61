"""Edit distances and the best-first search against plain Python."""

import random

from plain_lines import edits, similarity
from versionlink.functions.edits import edit_distance
from versionlink.operators.closest import closest


def test_distance():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(rng.randrange(n)))
    for _ in range(1500):
        a, b, most = word(25), word(25), rng.randrange(25)
        d = edits(a, b)
        assert edit_distance(a, b) == d
        assert edit_distance(a, b, most) == d if d <= most else edit_distance(a, b, most) in (None, d)
    text = "".join(rng.choice("abc ") for _ in range(9000))
    assert edit_distance(text, text[:4000] + "xx" + text[4003:] + "y") == 4
    assert edit_distance("", "") == 0 and edit_distance("", "ab") == 2


def test_closest_in_one_and_in_many_tiles(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ö"]) for _ in range(rng.randrange(5)))
    left = [(rng.choice("pq"), text()) for _ in range(60)] + [("p", ""), ("p", None), ("only", "here"), ("q", "x" * 900)]
    right = [(rng.choice("pq"), text() + rng.choice(["", "s"])) for _ in range(60)] + [("p", "x"), ("q", "x" * 880 + "y")]
    frames = [spark.createDataFrame(rows, f"b string, {c} string") for rows, c in ((left, "l"), (right, "r"))]
    for for_left, for_right in ((True, True), (True, False), (False, True)):
        want = set()
        for b in "pq":
            ls, rs = ({t for x, t in rows if x == b and t is not None} for rows in (left, right))
            pairs = {(l, r): similarity(l, r) for l in ls for r in rs}
            for (l, r), s in pairs.items():
                best_l = for_left and s == max(pairs[l, x] for x in rs)
                best_r = for_right and s == max(pairs[x, r] for x in ls)
                if best_l or best_r:
                    want.add((b, l, r, s, best_l, best_r))
        for cells in (1 << 32, 2_000):
            got = closest(*frames, ["b"], "l", "r", for_left, for_right, tile_cells=cells)
            assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    empty = spark.createDataFrame([], "b string, r string")
    assert closest(frames[0], empty, ["b"], "l", "r").count() == 0
