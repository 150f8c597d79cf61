"""What large steps write to disk: digests for texts, kept tables as columns, only pairs that may be won."""

import os

from pyspark.sql import functions as F

from versionlink import session
from versionlink.operators.assign import Tier, rounds_of_unique_best
from versionlink.plans import paths

LINES = "path string, line long, code string"


def sides(spark):
    """Ten files of one long line in two classes, and files that share short lines with them."""
    rows = lambda s: [(f"{s}{k}", 1, "a long line that all of them have") for k in range(10)] + [
        (f"{s}{k}", 2, f"own {k}") for k in range(8)] + [(f"{s}x", 1, "own 1"), (f"{s}x", 2, "own 2"), (f"{s}y", 1, "own 2")]
    return spark.createDataFrame(rows("o"), LINES), spark.createDataFrame(rows("n"), LINES)


def test_shared_lines_are_moved_as_digests(spark, monkeypatch):
    seen = []

    def positions(df, *rest, run=paths.positions):
        seen.append(dict(df.dtypes)["code"])
        return run(df, *rest)

    monkeypatch.setattr(paths, "positions", positions)
    old, new = sides(spark)
    weights = {(r.old_path, r.new_path): r.len for r in paths.shared_line_weight(old, new).collect()}
    assert weights["o1", "n1"] == len("a long line that all of them have") + 5 and weights["ox", "n2"] == 5
    assert paths.link_paths_by_content(old, new).count() == 10
    assert set(seen) == {"binary"}


def test_pairs_that_are_never_best_are_not_carried(spark):
    old, new = sides(spark)
    pairs = paths.shared_weight_of_two(old, new).cache()
    # o8, o9 and n8, n9 are never won and share the long line with all,
    all_pairs = {(r.old_path, r.new_path): r.len for r in paths.shared_line_weight(old, new).collect()}
    got = {(r.old_path, r.new_path): r.len for r in pairs.collect()}
    assert got.items() <= all_pairs.items()
    short = [p for p, n in all_pairs.items() if n == 5 and p[0] not in ("ox", "oy") and p[1] not in ("nx", "ny")]
    assert not short
    assert all(n >= 33 or {p[0], p[1]} & {"ox", "oy", "nx", "ny"} for p, n in got.items())
    links = lambda p: {(r.old_path, r.new_path) for r in rounds_of_unique_best(p, ["old_path"], ["new_path"], [Tier("len")]).collect()}
    everything = spark.createDataFrame([(*p, n) for p, n in all_pairs.items()], "old_path string, new_path string, len long")
    assert links(pairs) == links(everything) >= {(f"o{k}", f"n{k}") for k in range(8)}


def test_less_than_a_lasting_tie_is_dropped(spark):
    # class 1 of either side has two paths; 2 and 2 share less with each other than with those
    weights = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (2, 1, 5), (2, 2, 3), (2, 3, 7), (3, 2, 3)], "old_class long, new_class long, len long")
    classes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, None)], "class long, path string")
    kept = paths._that_may_be_best(weights, classes, classes)
    assert {tuple(r) for r in kept.collect()} == {(1, 1, 9), (1, 2, 5), (2, 1, 5), (2, 3, 7), (3, 2, 3)}


def test_kept_tables(spark):
    rows = [(k, f"text {k % 3}" if k % 5 else None, [k]) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string, list array<long>").withColumn("number", F.monotonically_increasing_id())
    kept = session.keep(df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.collect())) and kept.schema.fieldNames() == df.schema.fieldNames()
    assert sorted(map(tuple, kept.select("id", "text").collect()), key=str) == sorted([r[:2] for r in rows], key=str)
    # the files lie in the folder of a checkpoint that the plan holds
    files = [f.removeprefix("file://") for f in kept.inputFiles()]
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert files and all("/rdd-" in f and os.path.exists(f) for f in files) and "LogicalRDD" in plan
    assert session.keep(df.where("id < 0")).count() == 0


def test_garbage_is_released_between_steps(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(session, "RELEASE_EVERY", 0.0)
    monkeypatch.setattr(session.gc, "collect", lambda: calls.append(1))
    session.keep(session.settle(spark.range(3).toDF("id")))
    assert len(calls) == 2
