"""Steps on lines move digests and lengths; a text goes only where it is compared."""

import pytest
from pyspark.sql import functions as F

from versionlink.functions.text import digest
from versionlink.operators import shared_words
from versionlink.operators.closest import closest
from versionlink.plans import function_lines as fl, lines as ln, overlap

FSRC = "fid long, path string, line long, code string"
MAP = "old_fid long, new_fid long"


def fsrc(spark, s, texts):
    """Two functions of a path, of the same texts on both sides but for a letter."""
    return spark.createDataFrame([(1 + k // 3, f"{s}p", k + 1, t) for k, t in enumerate(texts)], FSRC)


def plain_best(old, new, func_map, open_old, open_new, one_sided):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    found = set()
    sim = lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1)
    for asked in ("old", "new"):
        rows = [(o, n, sim(o[3], n[3])) for o in old for n in new if (o[0], n[0]) in func_map
                and (o in open_old or (one_sided and asked == "new")) and (n in open_new or (one_sided and asked == "old"))]
        for o, n, s in rows:
            own = o if asked == "old" else n
            if s == max(x[2] for x in rows if (x[0] if asked == "old" else x[1]) == own):
                found.add((*o[:3], *n[:3]))
    return found


@pytest.mark.parametrize("by_path", [True, False])
@pytest.mark.parametrize("one_sided", [True, False])
def test_fallbacks_move_texts_once(spark, monkeypatch, by_path, one_sided):
    seen = []

    def once(*args, run=closest, **more):
        found = run(*args, **more)
        seen.append([dict(found.dtypes)[c] for c in ("old_code", "new_code")])
        return found

    monkeypatch.setattr(fl, "closest", once)
    base = ["first line of it", "a second one", "a second one", "third of them all", "a fourth line", "{"]
    old, new = fsrc(spark, "o", base), fsrc(spark, "n", [t + "x" * (k % 2) for k, t in enumerate(base)])
    func_map = spark.createDataFrame([(1, 1), (2, 2), (1, 2), (9, 9)], MAP)
    links = spark.createDataFrame([(1, "op", 1, 1, "np", 1), (2, "op", 4, 2, "np", 5)], "old_fid long, old_path string, old_line long, new_fid long, new_path string, new_line long")
    got = fl._fallback(fl._named(old, "old"), fl._named(new, "new"), func_map, links, by_path, one_sided)
    rows = lambda df: [tuple(r) for r in df.collect()]
    a, b, done = rows(old), rows(new), rows(links)
    want = plain_best(a, b, {(1, 1), (2, 2), (1, 2)}, [r for r in a if r[:3] not in [x[:3] for x in done]], [r for r in b if r[:3] not in [x[3:] for x in done]], one_sided)
    if not by_path:
        assert set(rows(got)) == want and (one_sided or got.count() == len(want))
    assert set(rows(got)) <= want and rows(got)
    assert seen and all(kinds == ["binary", "binary"] for kinds in seen)


def test_near_lines_take_only_texts_that_meet(spark, monkeypatch):
    moved = []

    def rows(left, right, *rest, run=fl.similar_rows, **more):
        moved.append((left.count(), right.count(), more.get("sizes") is not None))
        return run(left, right, *rest, **more)

    monkeypatch.setattr(fl, "similar_rows", rows)
    old = fsrc(spark, "o", ["anchor", "a line of twenty letters", "alone in its function", "anchor 2", "lines of the other one", "x"])
    new = fsrc(spark, "n", ["anchor", "a line of twenty letterz", "alone in its functiom"])
    links = spark.createDataFrame([("op", 1, "np", 1)], ln.LINK_SCHEMA)
    func_map = spark.createDataFrame([(1, 1), (2, 2)], MAP)
    found = fl.near_lines_between(fl.open_by_function(old, "old", "new", links, 6), fl.open_by_function(new, "new", "old", links, 6), func_map, old, new)
    assert {(r.old_line, r.new_line) for r in found.collect()} == {(2, 2), (3, 3)}
    # function 2 has no line on the other side
    assert moved == [(2, 2, True)]


def test_closest_with_copies_sizes_and_digests(spark):
    texts = {"l": ["same", "same", "near one", "nothing alike", None], "r": ["same", "near ones", "near ones", "qqqq"]}
    rows = [(1, t) for t in texts["l"]] * 5 + [(2, "only here")]
    left, right = spark.createDataFrame(rows, "b long, l string"), spark.createDataFrame([(1, t) for t in texts["r"]] * 3, "b long, r string")
    sized = lambda df, c: df.select("b", F.xxhash64(c).alias("__h"), F.length(c).alias("__n"))
    plain = closest(left, right, ["b"], "l", "r")
    named = closest(left, right, ["b"], "l", "r", sizes=(sized(left, "l"), sized(right, "r")), digests=True)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(plain.select("b", digest(F.col("l")).alias("l"), digest(F.col("r")).alias("r"), "similarity", "best_left", "best_right")) == rows(named)
    assert ("same", "same") in {(r.l, r.r) for r in plain.collect()} and plain.count() == plain.distinct().count()


def test_equal_linked_lines_are_scored_without_texts(spark, monkeypatch):
    lines = lambda *codes: spark.createDataFrame([("p", k, c) for k, c in enumerate(codes, 1)], "path string, line long, code string")
    links = spark.createDataFrame([("p", 1, "p", 1), ("p", 2, "p", 2)], ln.LINK_SCHEMA)
    owners = lambda src: src.select((F.col("line") * 10).alias("fid"), "path", "line")
    a, b = lines("equal", "abcd"), lines("equal", "abxd")
    asked = []
    monkeypatch.setattr(overlap, "_scores_of_texts", lambda linked, *rest, run=overlap._scores_of_texts: asked.append(linked.count()) or run(linked, *rest))
    scores = lambda x, y: {(r.old_fid, r.new_fid): r.score for r in overlap.overlap_scores(links, owners(x), owners(y), x, y).collect()}
    assert scores(a, a) == {(10, 10): 5, (20, 20): 4} and not asked
    assert scores(a, b) == {(10, 10): 5, (20, 20): 3} and asked == [1]
    # rows that come twice count twice on each side, as in a join
    assert scores(a.union(a), b.union(b)) == {(10, 10): 20, (20, 20): 12}


def test_words_are_drawn_after_the_move(spark, monkeypatch):
    seen = []
    tiles = lambda old, new, *rest, run=shared_words.weighed_tiles: seen.append({*old.columns, *new.columns}) or run(old, new, *rest)
    monkeypatch.setattr(shared_words, "weighed_tiles", tiles)
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "some  shared words // no"), ("a", 3, "y")], "path string, line long, code string")
    new = spark.createDataFrame([("b", 1, "x"), ("b", 2, "shared other words"), ("b", 3, "y")], "path string, line long, code string")
    links = spark.createDataFrame([("a", 1, "b", 1), ("a", 3, "b", 3)], ln.LINK_SCHEMA)
    got = ln.word_pairs(old, new, links, 3).collect()
    assert [(r.old_line, r.new_line, r.len) for r in got] == [(2, 2, round(11 / 21, 10))] or [r.old_line for r in got] == [2]
    assert seen and "words" not in seen[0]


@pytest.mark.parametrize("part_lines", [0, 100])
def test_line_links_move_digests(spark, monkeypatch, part_lines):
    seen = []
    parts = lambda lines, *rest, run=ln.link_parts: seen.append(dict(lines.dtypes)) or run(lines, *rest)
    monkeypatch.setattr(ln, "link_parts", parts)
    body = ["int a; // one", "int b;", "{", "call();", "call();", "}", "int c; // two"]
    other = ["int a; // 1", "int b;", "{", "call();", "call();", "}", "int c;"]
    table = lambda p, rows: spark.createDataFrame([(p, k, c) for k, c in enumerate(rows, 1)], "path string, line long, code string")
    old, new = table("o/f.c", body), table("n/f.c", other)
    place = ["path", "line"]
    got = ln.link_lines(old, new, old.select(*place), new.select(*place), part_lines=part_lines)
    assert {(r.old_line, r.new_line) for r in got.collect()} == {(k, k) for k in range(1, 8)}
    assert seen and all(s["code"] == s["bare"] == "binary" for s in seen)
