"""Blocks of functions of one file meet, whatever link their functions have."""

from versionlink.queries import graph

SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


def test_functions_of_one_file_meet(spark, tmp_path):
    # 0 and 7 are in one file, 18 and 21 are three apart, 0 and 31 in two files; all blocks share a hash
    rows = [(fid, line, 100, 1, 5.0) for fid in (0, 7, 18, 21, 31) for line in (1, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r.old_func, r.new_func) for r in graph.cross_map_rows(spark, str(tmp_path)).collect()}
    assert found == {("o0", "n7"), ("o18", "n7"), ("o18", "n21")}
    assert {r.new_fid for r in graph.cross_projection(spark, str(tmp_path)).collect()} == {7, 21}
    assert [tuple(r) for r in graph.cross_edge_weights(spark, str(tmp_path)).where("new_fid = 7").collect()] == [(7, 0, 1, 5)]


def test_promotion_inside_a_file(spark, tmp_path):
    # 0 is linked to 1, with which it shares no block, but shares its blocks with 7
    rows = [(0, 1, 100, 1, 5.0), (1, 1, 101, 1, 5.0), (7, 1, 100, 1, 5.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r.old_fid, r.new_fid) for r in graph.link_promotion(spark, str(tmp_path)).collect()] == [(0, 7)]
