"""The whole-pipeline queries run their loops until dry."""

from versionlink.queries import graph, link

LINES = "path string, line long, code string"


def numbered(path, codes):
    return [(path, k, code) for k, code in enumerate(codes, 1)]


def test_lines_until_dry(spark, monkeypatch):
    # between the two anchors both old lines are nearest to the first new one: a round each
    old = numbered("a/1", ["start of it", "abcdefghij", "abcdefgxyz", "end of it"])
    new = numbered("new/a/1", ["start of it", "abcdefghik", "abcdeuvwxy", "end of it"])
    # a passage that moved to another path
    old += numbered("a/2", ["one two three", "moved passage first", "moved passage second"]) + numbered("a/3", ["seven eight nine"])
    new += numbered("new/a/2", ["one two three"]) + numbered("new/a/3", ["seven eight nine", "moved passage first", "moved passage second"])
    tables = spark.createDataFrame(old, LINES), spark.createDataFrame(new, LINES).selectExpr("*", "line as true_old_line")
    monkeypatch.setattr(link.fx, "edited_lines", lambda *_: tables)
    got = {(r.old_path, r.old_line, r.new_path, r.new_line) for r in link.line_link_all(spark, "").collect()}
    want = {("a/1", k, "new/a/1", k) for k in range(1, 5)}
    want |= {("a/2", 1, "new/a/2", 1), ("a/3", 1, "new/a/3", 1), ("a/2", 2, "new/a/3", 2), ("a/2", 3, "new/a/3", 3)}
    assert got == want


def test_queries_pass_no_cap(spark, monkeypatch):
    asked = []
    old = spark.createDataFrame(numbered("a/1", ["x y", "z"]), LINES)
    tables = old, old.selectExpr("concat('new/', path) path", "line", "code", "line as true_old_line")
    monkeypatch.setattr(link.fx, "edited_lines", lambda *_: tables)
    monkeypatch.setattr(link.function_lines, "link_lines_with_functions", lambda *a, **k: asked.append((a[4:], k)))
    link.line_link_with_functions(spark, "")
    empty = spark.createDataFrame([], "old_fid long, old_bid long, new_fid long, new_bid long")

    def whole(*a, **k):
        asked.append((a[3:], k))
        return type("Found", (), {"blocks": empty})

    monkeypatch.setattr(graph, "link_versions", whole)
    graph.link_whole_versions(spark, "")
    assert asked == [((), {}), ((), {})]
