"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Per node the least node among itself and its neighbours (partial aggregation, no lists)."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of the undirected edges; the label is the least node reachable.

    Alternates large-star and small-star steps, each an aggregate joined back, until
    the edges are stars around their least nodes. A star of any size costs one
    step, a chain a number of steps that grows with the logarithm of its length.
    Null ends and loops are left out; an empty table gives an empty table.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    edges = stored(edges)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).filter("a > b").distinct()
        low = _least(large)
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
        ).filter("a > b").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
