"""Points go only to the cell sizes that spans have."""

from versionlink.operators.ranges import contain_join


def test_points_of_short_spans_have_one_cell(spark):
    points = spark.range(0, 1 << 34, 1 << 20).select("id").withColumnRenamed("id", "p")
    short = [(k << 20, (k << 20) + 5, k) for k in range(0, 100, 3)]
    schema = "lo long, hi long, k long"
    cells = lambda df: next(line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode([" in line)
    joined = contain_join(points, spark.createDataFrame(short, schema), [], "p", "lo", "hi", 1 << 34)
    assert "explode([6])" in cells(joined)  # not one cell that holds all points as well
    assert sorted((r.p, r.k) for r in joined.collect()) == [(lo, k) for lo, _, k in short]
    long = [*short, (0, 1 << 33, -1)]
    joined = contain_join(points, spark.createDataFrame(long, schema), [], "p", "lo", "hi", 1 << 34)
    assert "explode([6,36])" in cells(joined)
    assert joined.count() == len(short) + (1 << 13)
    assert contain_join(points, spark.createDataFrame([], schema), [], "p", "lo", "hi", 1 << 34).isEmpty()
