"""Votes for blocks whose counts are far apart."""

from versionlink.plans import blocks
from versionlink.queries import graph


def test_votes_whatever_the_counts(spark, tmp_path):
    # first blocks share a hash; the second ones hold linked jumps (items of line 3), their counts are 50 and 1
    old = [(0, 1, 100, 1, 50.0), (0, 2, 101, 1, 50.0), (0, 3, 104, 1, 50.0)]
    new = [(1, 1, 100, 1, 1.0), (1, 2, 102, 1, 1.0), (1, 3, 134, 1, 1.0)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(old + new, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    votes = [tuple(r) for r in graph.successor_votes_scored(spark, str(tmp_path)).collect()]
    assert votes == [(0, 1, 1, 1, 1)]
    assert [tuple(r) for r in graph.link_by_votes_scored(spark, str(tmp_path)).collect()] == [(0, 1, 1, 1)]


def test_votes_form_no_pairs_of_blocks(spark, monkeypatch):
    # two linked functions of 300 blocks, of which one pair is linked: its neighbours are the only pair with a vote
    monkeypatch.setattr(blocks, "neighbour_votes", None)
    node = lambda f: spark.createDataFrame([(f, b, 7 if b == 5 else f * 1000 + b + 1000) for b in range(300)], "fid long, bid long, hash long")
    edge = lambda f: spark.createDataFrame([(f, b, f, b + 1) for b in range(299)] * 2, "src_fid long, src_bid long, dst_fid long, dst_bid long")
    func_map = spark.createDataFrame([(0, 1)], "old_fid long, new_fid long")
    seed = blocks.link_blocks_by_hash(func_map, node(0), node(1))
    for via, to, block in (("src", "dst", 6), ("dst", "src", 4)):
        votes = blocks.votes_beside_links(func_map, seed, edge(0), edge(1), via, to)
        assert [tuple(r) for r in votes.collect()] == [(0, block, 1, block, 4)]
    other = spark.createDataFrame([(0, 2)], "old_fid long, new_fid long")
    assert blocks.votes_beside_links(other, seed, edge(0), edge(1), "src", "dst").isEmpty()
