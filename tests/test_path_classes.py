"""Path weights by classes of paths with the same shared lines, against plain Python."""

import random
from collections import Counter

from versionlink.operators.assign import Tier, rounds_of_unique_best
from versionlink.plans import paths

LINES = "path string, line long, code string"


def versions():
    """Many files of one common line, some of them with more, and one without a name."""
    rng = random.Random(5)
    sides = []
    for s in "on":
        src = {f"{s}{k}": ["same"] * rng.choice([1, 1, 1, 2]) + [f"l{rng.randrange(12)}" for _ in range(rng.choice([0, 0, 1, 3]))] for k in range(30)}
        src[f"{s}x"], src[f"{s}y"] = ["alone with it", "own" + s], ["{", "only" + s]
        for k in range(5):
            src[f"{s}u{k}"] = ["same", "u" * (k + 9)] + (["w" * 40] if k < 2 else [])
        src[None] = ["l1", "long line of files without a name"]
        sides.append(src)
    sides[0]["oz"] = sides[0][None]  # as the nameless file
    return sides


def weights(old, new):
    count = lambda body: Counter(c for c in body if c != "{")
    out = {}
    for o, a in old.items():
        for n, b in new.items():
            shared = count(a) & count(b)
            if shared:
                out[o, n] = sum(len(c) * k for c, k in shared.items())
    return out


def won(pairs):
    """Rounds of unique mutual best; a nameless path wins nothing, but its weight counts."""
    links = {}
    while True:
        best = {}
        for (o, n), w in pairs.items():
            best["o", o], best["n", n] = max(w, best.get(("o", o), w)), max(w, best.get(("n", n), w))
        top = [(o, n) for (o, n), w in pairs.items() if None not in (o, n) and w == best["o", o] == best["n", n]]
        a, b = Counter(o for o, _ in top), Counter(n for _, n in top)
        new = {(o, n): pairs[o, n] for o, n in top if a[o] == b[n] == 1}
        if not new:
            return links
        links |= new
        gone = {o for o, _ in new}, {n for _, n in new}
        pairs = {p: w for p, w in pairs.items() if p[0] not in gone[0] and p[1] not in gone[1]}


def table(spark, src):
    return spark.createDataFrame([(p, k, c) for p, body in src.items() for k, c in enumerate(body, 1)], LINES)


def test_weights_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(paths, "CLASS_CHUNK", 3)
    monkeypatch.setattr(paths, "CLASS_TILE", 2)
    old, new = versions()
    got = [tuple(r) for r in paths.shared_line_weight(table(spark, old), table(spark, new)).collect()]
    want = weights(old, new)
    assert len(got) == len(want) and {(o, n): w for o, n, w in got} == want


def test_two_paths_stand_for_a_class(spark):
    old, new = versions()
    pairs = paths.shared_weight_of_two(table(spark, old), table(spark, new)).cache()
    assert pairs.count() < len(weights(old, new)) * 0.6
    got = rounds_of_unique_best(pairs, ["old_path"], ["new_path"], [Tier("len")]).collect()
    want = won(weights(old, new))
    assert {(o, n): w for o, n, w in got} == want and len(want) > 3


def test_no_shared_lines(spark):
    a, b = table(spark, {"o": ["x"]}), table(spark, {"n": ["y"]})
    assert paths.shared_line_weight(a, b).count() == paths.shared_weight_of_two(a, b).count() == 0
