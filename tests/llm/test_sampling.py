"""The mix against its definition in plain Python."""

import hashlib
import random
import re

from versionlink.llm import sampling


def plain(rows):
    """doc_id, source, size to copies, by sorting every source whole."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()) * 1.5, {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    out = []
    for s in order:
        own = [r for r in rows if r[1] == s]
        c, level = {}, {r: len(bin(r[2])) - 2 for r in own}
        capped = set()
        while True:
            rest = sum(level[r] * r[2] for r in own if r not in capped)
            left = target[s] - 2 * sum(r[2] for r in own if r in capped)
            c = {r: 2.0 if r in capped else left * level[r] / rest if rest else 0.0 for r in own}
            more = {r for r in own if r not in capped and c[r] > 2}
            if not more:
                break
            capped |= more
        left = target[s] - sum(int(c[r] + 1e-12) * r[2] for r in own)

        def rank(r):
            p = c[r] - int(c[r] + 1e-12)
            u = (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return u * (1 - p) / ((1 - u) * p) if p > 1e-12 else float("inf")

        taken, chosen = 0, set()
        for r in sorted((r for r in own if r[2] and rank(r) < float("inf")), key=rank):
            if taken < round(left) and taken + r[2] - round(left) <= round(left) - taken:
                chosen.add(r)
            taken += r[2]
        out += [(r[0], sizes[s], round(target[s], 6), int(c[r] + 1e-12) + (r in chosen)) for r in own]
    return sorted(out)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "é", "b", "Z", None, "tiny"]) if k else "lone", rng.choice([0, 1, 5, 40, 300]))
            for k in range(400)]
    df = spark.createDataFrame(
        [(k, s, " \n".join(["w"] * n) if n or k % 2 else None, 1.0, "x") for k, s, n in rows],
        "doc_id long, source string, text string, size double, target string",
    )
    got = sampling.with_copies(df.repartition(5))
    assert {"size", "target"} < set(got.columns)
    found = sorted((r.doc_id, r._source_size, round(r._target, 6), r._copies) for r in got.collect())
    assert found == plain(rows)
    taken, target = {}, {}
    for r in got.collect():
        assert r._copies in (0, 1, 2)
        taken[r.source] = taken.get(r.source, 0) + r._copies * r._size
        target[r.source] = r._target
    assert all(abs(taken[s] - target[s]) <= 300 for s in taken)
    again = sampling.with_copies(df.repartition(2)).collect()
    assert sorted((r.doc_id, r._copies) for r in again) == sorted((r.doc_id, r._copies) for r in got.collect())
    assert sampling.mix(df).count() == sum(r._copies for r in again)


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert sampling.with_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None), (None, "a", "x y"), (1, "a", "x y"), (1, "a", "x y"), (2, "a", re.sub("", " ", "abc"))]
    got = sampling.with_copies(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(0 <= r._copies <= 2 for r in got)
    blank = sampling.with_copies(spark.createDataFrame([(1, "a", ""), (2, None, None)], schema)).collect()
    assert sum(r._copies * r._size for r in blank) == 0
