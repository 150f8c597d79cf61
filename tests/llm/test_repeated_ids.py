"""Different texts that share an id."""

from versionlink.llm import minhash


def test_keep_one_by_row(spark):
    text = lambda mark: " ".join(f"{mark}{k}" for k in range(60))
    rows = [
        (1, text("a")), (1, text("b")), (1, text("b")),  # two texts of one id, one of them repeated
        (2, text("c")), (2, text("c") + " more"), (3, text("c") + " yet"),  # near-copies, two under the least id
        (4, text("a")), (5, ""), (5, " "), (5, None), (None, text("a")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as label").repartition(3)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    near = [g for g in got if g[0] == 2]
    assert len(near) == 1 and near[0] in rows
    rest = [(1, text("a")), (1, text("b")), (5, ""), (5, " "), (5, None), (None, text("a"))]
    assert [g for g in got if g[0] != 2] == sorted(rest, key=str)
