"""Steps that only ask whether codes are equal move digests, not texts."""

from versionlink.plans import function_lines, lines


def test_same_code_steps_move_no_text(spark, monkeypatch):
    code = lambda k: f"line {k} " + "of a long text " * 20
    rows = [(1, "a", k, code(k % 7 if k > 3 else k + 50)) for k in range(1, 12)] + [(2, "a", 5, code(5))]
    fsrc = spark.createDataFrame(rows, "fid long, path string, line long, code string")
    func_map = spark.createDataFrame([(1, 1), (2, 2)], "old_fid long, new_fid long")
    seed = spark.createDataFrame([("a", 1, "a", 1)], lines.LINK_SCHEMA)
    seen = []
    for name in ("same_code_inside", "same_code_anywhere", "same_code_same_owners"):
        def step(own, *rest, run=getattr(function_lines, name), name=name):
            seen.append((name, dict(own.dtypes)["code"]))
            return run(own, *rest)
        monkeypatch.setattr(function_lines, name, step)
    got = function_lines.link_lines_with_functions(fsrc, fsrc, func_map, seed, remaining=False)
    assert {n for n, _ in seen} == {"same_code_inside", "same_code_anywhere", "same_code_same_owners"}
    assert {t for _, t in seen} == {"binary"}
    # lines 2 and 3 have their code alone, 4 and 11 share theirs; the rest follows between the links
    assert {(r.old_line, r.new_line) for r in got.collect()} >= {(k, k) for k in (1, 2, 3)}
    assert all(rows[r.old_line - 1][3] == rows[r.new_line - 1][3] for r in got.collect())


def test_unique_lines_by_digest(spark):
    long = "x" * 5000
    old = spark.createDataFrame([("a", 1, long + "1"), ("a", 2, long + "2"), ("a", 3, long + "2"), ("a", 4, None)], "path string, line long, code string")
    new = spark.createDataFrame([("b", 7, long + "1"), ("b", 8, long + "2"), ("b", 9, None)], "path string, line long, code string")
    path_map = spark.createDataFrame([("a", "b")], "old_path string, new_path string")
    found = lines.equal_unique_lines(old, new, path_map)
    assert [tuple(r) for r in found.collect()] == [("a", 1, "b", 7)]
