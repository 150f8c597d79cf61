"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups that stay together.

Rows with equal texts are a group. A group is a partial partition: its bytes on
one of the shards, nothing on the others. Differencing takes the two partial
partitions with the largest spread and adds them up in opposite order, until
one is left. It runs level by level over a tree of buckets. The root differences
the groups too large for any bucket below (few, for their size) and hands every
child its part of the load they leave on the shards. A child differences its
own larger groups together with that load, which is a partial partition with named
shards, and so on; the last level takes all that is left. Uneven loads of large
groups are thus made up for by the small ones, and every group ends on a shard. A task
holds about ``BUCKET`` groups.

A group of more than a shard's fair part cannot stay whole in balance; it is dealt
into pieces by its ids. There are fewer than ``shards`` such groups, so they are
broadcast. Slots count the rows of a shard by hash range of their ids, so no task
orders a whole shard.

Row cases: null text counts as empty (size 1, checksum 0). Equal rows, ids and
texts, are separate rows of one group and get slots of their own. Null ids are one id.
Without rows there is no result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlink.llm.common import stored

SHARDS = 16
BUCKET = 20_000
FAN = 1_000
SLOT_ROWS = 20_000


def difference(parts: list[list[int]], named: int = -1) -> list[list[tuple[int, int]]]:
    """Karmarkar-Karp: combine the partial partitions ``parts`` (equally many sums each) into one.

    Per position of the result, the (part, position) pairs it is made of; empty positions
    are told of the part ``named`` only.
    """
    heap = []
    for k, sums in enumerate(parts):
        own = sorted(((s, (k, at)) for at, s in enumerate(sums)), key=lambda x: -x[0])
        tree = [(s, leaf if s or k == named else None) for s, leaf in own]
        heap.append((own[-1][0] - own[0][0], k, tree))
    heapq.heapify(heap)
    count = len(parts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(
            ((x + y, (s, t) if s and t else s or t) for (x, s), (y, t) in zip(a, reversed(b))), key=lambda x: -x[0]
        )
        count += 1
        heapq.heappush(heap, (both[-1][0] - both[0][0], count, both))
    return [list(_leaves(tree)) for _, tree in heap[0][2]] if heap else []


def _leaves(tree) -> Iterator[tuple[int, int]]:
    stack = [tree]
    while stack:
        node = stack.pop()
        if node is None:
            continue
        if isinstance(node[0], int):
            yield node
        else:
            stack.extend(node)


def _deal(items: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """``shard`` for ``group, piece, bytes, bucket``, given the ``loads`` (bucket, shard, bytes) before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        loaded = pdf["shard"].notna()
        before = [0] * shards
        for at, size in zip(pdf.loc[loaded, "shard"], pdf.loc[loaded, "bytes"]):
            before[int(at)] = int(size)
        own = pdf[~loaded].sort_values(["bytes", "group", "piece"], ascending=[False, True, True], ignore_index=True)
        place = np.zeros(len(own), np.int32)
        parts = [[int(b), *[0] * (shards - 1)] for b in own["bytes"]] + [before]
        for leaves in difference(parts, len(own)):
            to = next(at for k, at in leaves if k == len(own))
            place[[k for k, _ in leaves if k < len(own)]] = to
        return own.assign(shard=place)

    schema = "group string, piece int, bytes long, bucket long, shard int"
    both = items.withColumn("shard", F.lit(None).cast("int")).select("group", "piece", "bytes", "bucket", "shard")
    return both.unionByName(loads.select(
        F.lit(None).cast("string").alias("group"), F.lit(-1).alias("piece"), "bytes", "bucket", "shard"
    )).groupBy("bucket").applyInPandas(run, schema)


def _assign(items: DataFrame, total: int, shards: int, bucket: int, fan: int) -> DataFrame:
    """``group, piece, shard`` by levels of buckets."""
    wanted = max(1, -(-items.count() // bucket))
    levels = 0
    while fan**levels < wanted:
        levels += 1
    width = 1 if levels == 0 else next(w for w in range(1, fan + 1) if w**levels >= wanted)
    items = items.withColumn("fine", F.pmod(F.xxhash64("group", "piece"), F.lit(width**levels)))
    level = F.lit(levels)
    for k in reversed(range(levels)):
        level = F.when(F.col("bytes") * shards * width ** (k + 1) > total, F.lit(k)).otherwise(level)
    items = items.withColumn("level", level)
    loads = items.sparkSession.range(shards).select(
        F.lit(0).cast("long").alias("bucket"), F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes")
    )
    found = []
    for k in range(levels + 1):
        own = items.filter(F.col("level") == k).withColumn("bucket", F.floor(F.col("fine") / width ** (levels - k)))
        dealt = stored(_deal(own, loads, shards))
        found.append(dealt.select("group", "piece", "shard"))
        if k < levels:
            after = loads.unionByName(dealt.select("bucket", "shard", "bytes")).groupBy("bucket", "shard").agg(
                F.sum("bytes").alias("bytes")
            )
            children = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.col("bucket") * width + c)
            loads = stored(after.select(
                F.explode(children).alias("bucket"), "shard", F.floor(F.col("bytes") / width).alias("bytes")
            ))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _number(rows: DataFrame) -> DataFrame:
    """``slot``: the rows of a shard numbered from 0 in the order of hash range, then id."""
    parts = max(1, rows.count() // (SHARDS * SLOT_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("part"))
    before = counts.select("shard", "part", (upto - F.col("n")).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    return rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["shard", "part"]).withColumn(
        "slot", (F.col("own") + F.col("before")).cast("long")
    )


def shard(docs: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Per row ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``bytes``."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"),
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    fair = max(1, total // shards)
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > fair).select(
        "group", F.ceil(F.col("bytes") * 4 / fair).cast("int").alias("pieces")
    )
    # fewer than ``shards`` groups can be that large
    rows = rows.join(F.broadcast(large), "group", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.col("pieces")).cast("int"), F.lit(0))
    ).drop("pieces")
    items = stored(rows.groupBy("group", "piece").agg(F.sum("size").alias("bytes")))
    where = _assign(items, total, shards, bucket, fan)
    placed = stored(rows.join(where, ["group", "piece"]))
    return _number(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
