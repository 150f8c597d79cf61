"""Functions with long names: their scores are spread over tasks by the letters they compare."""

import random

from versionlink.functions.similarity import edit_similarity, edit_similarity_of_long
from versionlink.operators import ordered
from versionlink.plans import functions as plan
from versionlink.plans.overlap import overlap_scores

COLUMNS = "fid long, func string, namespace string, basename string, parameters string, extension string, chunk string, path string, line long"


def rows(seed, first, count, size):
    rand = random.Random(seed)
    texts = ["".join(rand.choice("abc deé") for _ in range(rand.randint(size // 2, size))) for _ in range(count)]
    return [(first + k, f"{t}#{k}", "n", t, "()", "", "1", f"p{first + k}", 1) for k, t in enumerate(texts)]


def test_similarity_of_long_texts(spark):
    rand = random.Random(1)
    text = lambda n: "".join(rand.choice("abcé\U0001f600") for _ in range(n))
    pairs = [(text(rand.randint(0, 150)), text(rand.randint(0, 150))) for _ in range(200)]
    pairs += [(a, a[:20] + "x" + a[25:]) for a, _ in pairs[:50]] + [("", ""), ("a", ""), (None, "a"), (text(90), None), (None, None)]
    table = spark.createDataFrame(pairs, "a string, b string")
    got = table.select(edit_similarity("a", "b").alias("x"), edit_similarity_of_long("a", "b").alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and len(got) == 255


def test_long_names_are_scored_in_many_tasks(spark, monkeypatch):
    old, new = (spark.createDataFrame(rows(k, 1000 * k, 30, 400), COLUMNS) for k in (1, 2))
    want = {tuple(r) for r in plan.link_leftovers(old, new).collect()}
    asked, join = [], ordered.block_join
    monkeypatch.setattr(ordered, "block_join", lambda *a: asked.append(a[3:]) or join(*a))
    monkeypatch.setattr(ordered, "TASK_LETTERS", 1_000_000)
    assert {tuple(r) for r in plan.link_leftovers(old, new).collect()} == want and len(want) == 30
    (tile, tasks), = asked
    assert tasks > 20 and tile < 10


def test_blocks_beyond_a_task_are_cut_by_letters(spark, monkeypatch):
    old, new = (spark.createDataFrame(rows(k, 1000 * k, 12, 200), COLUMNS) for k in (3, 4))
    want = {tuple(r) for r in plan.link_leftovers(old, new).collect()}
    asked, join = [], ordered.block_join
    monkeypatch.setattr(ordered, "block_join", lambda *a: asked.append(a[3:]) or join(*a))
    monkeypatch.setattr(ordered, "TASK_LETTERS", 200_000)
    monkeypatch.setattr(ordered, "IN_TASK", 10)
    assert {tuple(r) for r in plan.link_leftovers(old, new).collect()} == want and len(want) == 12
    assert asked and all(tasks > 10 and tile < 12 for tile, tasks in asked)


def test_overlap_counts_long_lines_outside_spark(spark):
    lines = spark.createDataFrame([("p", 1, "x" * 100), ("p", 2, "short"), ("p", 3, None)], "path string, line long, code string")
    other = spark.createDataFrame([("q", 1, "x" * 50 + "y" + "x" * 50), ("q", 2, "sport"), ("q", 3, "z")], "path string, line long, code string")
    links = spark.createDataFrame([("p", k, "q", k) for k in (1, 2, 3)], "old_path string, old_line long, new_path string, new_line long")
    owners = lambda df: df.select((df.line * 10).alias("fid"), "path", "line")
    scores = overlap_scores(links, owners(lines), owners(other), lines, other)
    assert {r.old_fid: r.score for r in scores.collect()} == {10: 100, 20: 4, 30: None}
    assert "ArrowEvalPython" in scores._jdf.queryExecution().toString()
