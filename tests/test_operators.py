"""Operators against brute force on small random tables, with the large-group ways forced."""

import bisect
import random
from collections import defaultdict

from pyspark.sql import functions as F

from versionlink.operators.asof import asof_backward, asof_inside
from versionlink.operators.assign import Tier, rounds_of_unique_best
from versionlink.operators.closest import closest, similar_pairs
from versionlink.operators.fill import unlinked_between
from versionlink.operators.ordered import _block_links, rounds_of_ordered_best
from versionlink.operators.pairing import block_join
from versionlink.operators.ranges import contain_join
from versionlink.operators.ranks import positions
from versionlink.plans import paths


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def similarity(a, b):
    return 1.0 if a == b else 1.0 - lev(a, b) / max(len(a), len(b))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_of_a_hot_group(spark):
    data = [(0, i * 7 % 500) for i in range(500)] + [(g, i) for g in range(1, 6) for i in range(3)]
    df = spark.createDataFrame(data, "g int, v int")
    small = positions(df, ["g"], ["v"])
    spread = positions(df, ["g"], ["v"], task_rows=2)
    assert rows(small.select("g", "v", "position")) == rows(spread.select("g", "v", "position"))


def test_segmented_fill(spark):
    rng = random.Random(1)
    lines = sorted(rng.sample(range(1, 400_000), 300))
    linked = rng.sample(lines, 40)
    src = spark.createDataFrame([("p", v, "c") for v in lines], "path string, line long, code string")
    links = spark.createDataFrame([("p", v, v * 2) for v in linked], "path string, line long, link long")
    whole = unlinked_between(src, links, 100)  # pretends that one segment holds the path
    cut = unlinked_between(src, links, None)
    assert rows(whole) == rows(cut)
    ordered = sorted(linked)
    for r in cut.collect():
        at = bisect.bisect(ordered, r["line"])
        assert r["prev"] == (ordered[at - 1] * 2 if at else None)
        assert r["next"] == (ordered[at] * 2 if at < len(ordered) else None)


def test_asof_and_ranges(spark):
    rng = random.Random(2)
    spans = [(s, s + rng.randint(1, 40), i) for i, s in enumerate(sorted(rng.sample(range(0, 5000), 80)))]
    points = [(p,) for p in rng.sample(range(0, 5100), 300)]
    span_df = spark.createDataFrame(spans, "lo long, hi long, k long")
    point_df = spark.createDataFrame(points, "p long")
    want = sorted((p, k) for (p,) in points for lo, hi, k in spans if lo <= p < hi)
    assert rows(contain_join(point_df, span_df, [], "p", "lo", "hi", 5100).select("p", "k")) == want
    latest = []
    for (p,) in points:
        before = [s for s in spans if s[0] <= p]
        if before and p < before[-1][1]:
            latest.append((p, before[-1][2]))
    assert rows(asof_inside(point_df, span_df, "p", "lo", "hi", ["k"]).select("p", "k")) == sorted(latest)
    marks = span_df.select(F.col("lo").alias("p"), "k")
    seen = {r["p"]: r["k"] for r in asof_backward(point_df, marks, ["p"], ["k"]).collect()}
    starts = [s[0] for s in spans]
    assert seen == {p: (spans[bisect.bisect(starts, p) - 1][2] if bisect.bisect(starts, p) else None) for (p,) in points}


def test_tiles_give_the_same_pairs(spark):
    old = spark.createDataFrame([(i % 3, i) for i in range(60)], "b int, x int")
    new = spark.createDataFrame([(i % 4, i) for i in range(80)], "b int, y int")
    assert rows(block_join(old, new, ["b"], tile_rows=3)) == rows(old.join(new, "b"))


def test_unique_rounds(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(30), rng.randrange(30)): rng.randrange(6) for _ in range(200)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "o int, n int, s int")
    got = rows(rounds_of_unique_best(df, ["o"], ["n"], [Tier("s")]).select("o", "n"))
    open_pairs, want = dict(pairs), []
    while True:
        bo, bn = defaultdict(int), defaultdict(int)
        for (a, b), s in open_pairs.items():
            bo[a], bn[b] = max(bo[a], s), max(bn[b], s)
        best = [(a, b) for (a, b), s in open_pairs.items() if s == bo[a] == bn[b]]
        won = [(a, b) for a, b in best if sum(x == a for x, _ in best) == 1 and sum(y == b for _, y in best) == 1]
        if not won:
            break
        want += won
        done_o, done_n = {a for a, _ in won}, {b for _, b in won}
        open_pairs = {k: v for k, v in open_pairs.items() if k[0] not in done_o and k[1] not in done_n}
    assert got == sorted(want)


def ordered_rounds(old, new, score):
    """Literal rounds: best for both fids, first per old, then first per new."""
    pairs = [(score(o, n), o[1], n[1], o[0], n[0]) for o in old for n in new if o[2] == n[2]]
    won = []
    while pairs:
        bo, bn = {}, {}
        for s, _, _, o, n in pairs:
            bo[o], bn[n] = max(bo.get(o, s), s), max(bn.get(n, s), s)
        best = sorted((fo, fn, o, n) for s, fo, fn, o, n in pairs if s == bo[o] == bn[n])
        by_old = {}
        for p in best:
            by_old.setdefault(p[2], p)
        by_new = {}
        for p in sorted(by_old.values()):
            by_new.setdefault(p[3], p)
        won += [(p[2], p[3]) for p in by_new.values()]
        done_o, done_n = {p[2] for p in by_new.values()}, {p[3] for p in by_new.values()}
        pairs = [p for p in pairs if p[3] not in done_o and p[4] not in done_n]
    return sorted(won)


def test_ordered_rounds(spark):
    rng = random.Random(4)
    make = lambda first: [
        (first + 2 * i, f"f{rng.randrange(1000):04d}", rng.choice("ab"), rng.choice(["x", "xy", "xyz", "yz"]) ) for i in range(24)]
    old, new = make(0), make(1)
    # a third of the rows are copies of one class
    old += [(1000 + 2 * i, f"h{i:03d}", "c", "same") for i in range(12)]
    new += [(1001 + 2 * i, f"h{i:03d}", "c", "same") for i in range(9)]
    schema = "fid long, func string, block string, value string"
    from versionlink.functions.similarity import edit_similarity

    score = lambda a, b: F.struct(edit_similarity(a("value"), b("value")).alias("s"))
    want = ordered_rounds(old, new, lambda o, n: similarity(o[3], n[3]))
    old += [(2000, "s", "d", "yz"), (2002, "r", None, "x"), (2004, "q", "e", "x")]  # a small block, no block, none to meet
    new += [(2001, "s", "d", "xyz"), (2003, "t", "d", "yz"), (2005, "r", None, "x")]
    want += [(2000, 2003)]
    # all blocks by rounds, all in tasks; large ones by rounds and small ones in tasks, rows of several names
    for kept, aliases, together in ((0, False, 0), (10**9, False, None), (10**9, False, 110), (10**9, True, None)):
        got = rounds_of_ordered_best(
            spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["block"], ["value"],
            score, None, aliases, stored_pairs=kept, in_task=together)
        assert sorted(rows(got.select("old_fid", "new_fid"))) == sorted(want)


def test_ordered_ties_reached_later(spark):
    """A class that reaches a tie in a later round takes its place in it by name."""
    from versionlink.functions.similarity import edit_similarity

    old = [(0, "a1", "k", "xxxy"), (2, "z9", "k", "xxxy"), (4, "c1", "k", "xyxx"), (6, "d1", "k", "xyxx")]
    new = [(1, "x1", "k", "xxxx"), (3, "x2", "k", "xxxx"), (5, "y1", "k", "xyxx")]
    rng = random.Random(11)
    tables = [(old, new)] + [tuple(
        [(s + 2 * i, f"f{rng.randrange(100):02d}", "k", rng.choice(["xxxy", "xyxx", "xxxx", "xyxy", "yxxx", "x"])) for i in range(30)]
        for s in (0, 1)) for _ in range(3)]
    schema = "fid long, func string, block string, value string"
    score = lambda a, b: F.struct(edit_similarity(a("value"), b("value")).alias("s"))
    for old, new in tables:
        want = ordered_rounds(old, new, lambda o, n: similarity(o[3], n[3]))
        for together in (0, None):
            got = rounds_of_ordered_best(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["block"], ["value"],
                                         score, None, False, in_task=together)
            assert sorted(rows(got.select("old_fid", "new_fid"))) == sorted(want)


def test_rounds_of_one_block():
    """The rounds that run in a task against the rule of one pair a round, with many ties and equal names."""
    rng = random.Random(12)
    for _ in range(300):
        values = [f"v{k}" for k in range(rng.randint(1, 5))]
        given = {(a, b): rng.randint(0, 3) for a in values for b in values}
        side = lambda first: [(first + 2 * i, f"f{rng.randrange(8)}", "k", rng.choice(values)) for i in range(rng.randint(1, 12))]
        old, new = side(0), side(1)
        classes = lambda rows: {v: [(r[1], r[0]) for r in rows if r[3] == v] for v in {r[3] for r in rows}}
        a, b = classes(old), classes(new)
        pairs = {(x, y): (given[x, y],) for x in a for y in b}
        want = ordered_rounds(old, new, lambda o, n: given[o[3], n[3]])
        assert sorted((link[0], link[2]) for link in _block_links(pairs, a, b)) == sorted(want)


def random_texts(rng, count):
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30))) for _ in range(count)]
    return base + [t + rng.choice("abx") for t in base[: count // 2]] + [t[:3] + "z" + t[4:] for t in base[: count // 2]]


def test_closest_and_similar(spark):
    rng = random.Random(5)
    old = [(rng.randrange(3), t) for t in random_texts(rng, 20)] + [(0, "copy")] * 30 + [(0, "}"), (0, ""), (1, "x")]
    new = [(rng.randrange(3), t) for t in random_texts(rng, 20)] + [(b, t) for b, t in old[:8]] + [(0, "copz")] * 30 + [(0, "}"), (0, ""), (1, "y")]
    left, right = spark.createDataFrame(old, "b int, l string"), spark.createDataFrame(new, "b int, r string")
    pairs = {(b, x, y): similarity(x, y) for b, x in set(old) for c, y in set(new) if b == c}
    best_l, best_r = defaultdict(float), defaultdict(float)
    for (b, x, y), s in pairs.items():
        best_l[b, x], best_r[b, y] = max(best_l[b, x], s), max(best_r[b, y], s)
    want = sorted((b, x, y, s == best_l[b, x], s == best_r[b, y]) for (b, x, y), s in pairs.items() if s in (best_l[b, x], best_r[b, y]) and (s == best_l[b, x] or s == best_r[b, y]))
    assert rows(closest(left, right, ["b"], "l", "r").select("b", "l", "r", "best_left", "best_right")) == want
    for least in (0.8, 0.9):
        near = sorted(k for k, s in pairs.items() if s >= least)
        for small in (0, 10_000):  # 0 sends every block through the gram filter
            assert rows(similar_pairs(left, right, ["b"], "l", "r", least, small).select("b", "l", "r")) == near


def test_common_lines_by_groups(spark):
    rng = random.Random(6)
    def side(name):
        data = []
        for p in range(14):
            codes = ["license", "import os"][: rng.randint(0, 2)] + [f"line {rng.randrange(12)}" for _ in range(rng.randint(0, 3))]
            data += [(f"{name}{p}", i + 1, c) for i, c in enumerate(codes)]
        return spark.createDataFrame(data, "path string, line long, code string")

    for _ in range(3):
        old, new = side("o"), side("n")
        assert rows(paths.link_paths_by_content(old, new)) == rows(paths.link_paths_by_content(old, new, common_pairs=4))
