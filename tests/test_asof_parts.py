"""As-of joins over many parts, with parts that hold no mark, ties and empty inputs."""

import random

from versionlink.operators.asof import asof_backward


def test_marks_are_carried_over_parts(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(400), k) for k in range(900)]
    marks = [("a", 30, "x", 1), ("a", 30, "y", 2), ("a", 31, None, 3), ("b", 100, "z", None), ("b", 100, "w", 5), ("b", 390, "q", 6)]
    row_df = spark.createDataFrame(rows, "f string, n long, k long")
    mark_df = spark.createDataFrame(marks, "f string, n long, v string, w long")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        found = asof_backward(row_df, mark_df, ["f", "n"], ["v", "w"])
        got = sorted((r.f, r.n, r.k, r.v, r.w) for r in found.collect())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        empty = asof_backward(row_df, mark_df.limit(0), ["f", "n"], ["v", "w"]).collect()
        assert asof_backward(row_df.limit(0), mark_df, ["f", "n"], ["v", "w"]).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    best = lambda f, n: max((m for m in marks if m[:2] <= (f, n)), key=lambda m: (m[0], m[1], m[2] or "", m[3] or 0), default=(None,) * 4)
    assert got == sorted((f, n, k, *best(f, n)[2:]) for f, n, k in rows)
    assert len(empty) == 900 and all(r.v is None and r.w is None for r in empty)
    # rows are moved once, by the range partition that the checkpoint holds
    assert not [line for line in plan.split("\n") if "Window" in line and "__row" in line] and "__all" not in plan
