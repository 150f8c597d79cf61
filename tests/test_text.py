import os.path

from pyspark.sql import functions as F

from versionlink.functions import similarity as sim, text
from versionlink.sources import links, listing, logs
from versionlink.sources.files import read_paths, split_sources


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()["x"]


def test_normal_path(spark):
    paths = ["/a/./b/../c", "a//b", "../x", "/..", "", "//a/b/", "///a", "a/..", "./a", "../../b/.."]
    rows = spark.createDataFrame([(p,) for p in paths], ["p"]).select("p", text.normal_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == {p: os.path.normpath(p) for p in paths}


def test_comment_lines(spark):
    source = 'int a; /* one\n two */ int b;\n\n  \nint c; // tail\n/* whole */\nx /* p */ y\n'
    rows = split_sources(spark.createDataFrame([("f.c", source)], ["path", "text"])).collect()
    # code before a comment over lines goes to the line where the comment ends
    assert [(r["line"], r["code"]) for r in sorted(rows)] == [(2, "int a;  int b;"), (5, "int c; // tail"), (7, "x  y")] or \
        sorted((r["line"], r["code"]) for r in rows) == [(2, "int a;  int b;"), (5, "int c; // tail"), (7, "x  y")]


def test_similarity_edges(spark):
    assert one(spark, sim.edit_similarity("a", "b"), a="", b="") == 1.0
    assert one(spark, sim.edit_similarity("a", "b"), a="abcd", b="abxd") == 0.75
    assert one(spark, sim.overlap_length("a", "b"), a="abcd", b="abxd") == 3
    assert one(spark, sim.suffix_distance("a", "b"), a="cold.12", b="cold.15") == 3e-12
    assert one(spark, sim.suffix_distance("a", "b"), a="cold", b="llvm.7") == 2 + 7e-12
    assert one(spark, sim.suffix_distance("a", "b"), a="", b="x") == 1.0


def test_logs(spark, tmp_path):
    lines = [
        "Log-LineInfo#_Z1f/2#a#f#(int)##/s/./a.cpp#7#3#12#991#4",
        "Log-Counts: func f,g, 18446744073709551615 4096 0 0",
        "Log-Counts: node 4096#0 5 0 16 9223372036854775809 4",
        "Log-Counts: edge 4096#0 4096#1 7", "Log-Counts: edge 4096#0 4096#1 7", "other?line\"",
    ]
    path = tmp_path / "log.txt"
    path.write_text("\n".join(lines) + "\n")
    info = logs.read_function_info(spark, str(path)).first()
    assert (info["func"], info["chunk"], info["file"], info["line"]) == ("_Z1f/2", "2", "/s/a.cpp", 7)
    functions, nodes, edges = logs.read_graph(spark, str(path))
    assert sorted(tuple(r) for r in functions.collect()) == [(4096, "f", -1), (4096, "g", -1)]
    node = nodes.first()
    assert (node["start_address"], node["end_address"], node["hash"]) == (4096, 4112, -9223372036854775807)
    assert edges.count() == 2  # parallel edges stay


def test_listing(spark, tmp_path):
    path = tmp_path / "listing.txt"
    path.write_text("  ff: \tnop\n; ./obj/a/../b.c:12\n  100: \tmov\tx ? \"y\"\n  10f: \tret\n; bad\n  110: \tjmp\t0x100 <f+0x0>\n")
    nodes = spark.createDataFrame([(1, 0, 256, 272)], "fid long, bid long, start_address long, end_address long")
    rows = listing.read_instructions(spark, str(path), nodes).orderBy("address").collect()
    assert [(r["path"], r["line"], r["address"], r["instruction"]) for r in rows] == [
        ("b.c", 12, 256, 'mov\tx ? "y"'), ("b.c", 12, 271, "ret")]


def test_link_readers(spark, tmp_path):
    cross = tmp_path / "cross.csv"
    cross.write_text("n,1,o,2\nn,3,o,2\nmissing,1,o,4\nbad\n")
    names = lambda n: spark.createDataFrame([(n,)], ["func"])
    found, rejected = links.read_cross_map(spark, str(cross), names("n"), names("o"))
    assert [tuple(r) for r in found.collect()] == [("n", 3, "o", 2)]
    assert sorted(r[0] for r in rejected.collect()) == ["bad", "missing,1,o,4"]
    blocks = spark.createDataFrame([("o", 2, 9), ("o", 5, 6)], "old_func string, old_bid long, new_bid long")
    assert sorted(tuple(r) for r in links.with_tombstones(blocks, found).collect()) == [("o", 2, -1), ("o", 5, 6)]


def test_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.c").write_text("a")
    (tmp_path / "y.c").write_text("b")
    rows = read_paths(spark, [str(tmp_path)]).collect()
    assert sorted(r["path"] for r in rows) == [str(tmp_path / "d" / "x.c"), str(tmp_path / "y.c")]
