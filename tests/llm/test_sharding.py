"""Differencing: balance, groups that stay together, gapless slots."""

import random
import zlib
from collections import Counter

from versionlink.llm import sharding


def check(rows, df, **kw):
    got = sharding.shard(df, **kw).collect()
    assert len(got) == len(rows)
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = {}, Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, sizes


def test_difference_beats_greedy():
    rng = random.Random(2)
    for ways in (2, 3, 16):
        parts = [[rng.randrange(1, 1000), *[0] * (ways - 1)] for _ in range(200)]
        positions = sharding.difference(parts)
        assert sorted(k for p in positions for k, at in p) == list(range(200))
        sums = [sum(parts[k][at] for k, at in p) for p in positions]
        assert max(sums) - min(sums) <= 40
    assert sharding.difference([]) == []
    assert sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]) and sorted(
        sum([8, 7, 6, 5, 4][k] for k, _ in p) for p in sharding.difference([[x, 0] for x in (8, 7, 6, 5, 4)])
    ) == [14, 16]


def test_shards(spark):
    rng = random.Random(4)
    rows = [(k, "ä" * rng.randrange(1, 400) + str(k)) for k in range(1500)]
    rows += [(2000 + k, "same text") for k in range(60)] + [(None, None), (None, None), (5, ""), (5, ""), (9000, "x" * 20_000)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, shard int, group string").repartition(4)
    got, sizes = check(rows, df)
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * max(sizes.values())
    assert len({r.shard for r in got if 2000 <= (r.doc_id or 0) < 2060}) == 1
    _, sizes = check(rows, df, bucket=100, fan=3)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 400  # an ordinary text


def test_hot_group_is_dealt(spark):
    rows = [(k, "one text that a third of all share") for k in range(1000)] + [(1000 + k, f"own {k} " * 8) for k in range(1000)]
    _, sizes = check(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(sizes.values()) <= 1.2 * min(sizes.values())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
