"""Importance resampling against plain Python, and the selection against sorting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from versionlink.llm import resampling
from versionlink.llm.resampling import Key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORD.findall(lower(text))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least, longest, buckets):
    count = lambda texts: np.bincount([f % buckets for t in texts for f in features(t, longest)] or [0], minlength=buckets) - (
        np.bincount([0], minlength=buckets) if not any(features(t, longest) for t in texts) else 0)
    s, t = count([x for _, x in docs]), count(target)
    total_s, total_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (total_s + buckets) / ((int(s[b]) + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        own = features(text, longest)
        weight = sum(gain[f % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] if r[0] is not None else 1 << 63))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((*r, drawn.get(id(r))) for r in rows if r[0] is not None), sum(1 for r in rows if r[0] is None and id(r) in drawn)


@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, longest):
    rng = random.Random(longest)
    words = ["Ärger", "wood", "tree", "lake", "x1", "snake_case", "İ", "fine", "stone", "river"]
    docs = [(k, " ".join(rng.choice(words[: rng.randrange(1, 11)]) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(None, "tree " * 40), (500, None), (501, ""), (502, "!? _"), (503, "lake-tree " * 40_000)]
    target = ["tree lake wood " * 5, None, "", "Fine stone"]
    df = spark.createDataFrame([(*d, 1.5, "a", 7, 8) for d in docs], "doc_id long, text string, weight double, rank string, id int, row int")
    got = resampling.resample(
        df.repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), 25, longest=longest, buckets=64)
    assert got.columns == ["row", "n_features", "weight", "score", "rank"]
    assert set(got.select("row.*").columns) == {"doc_id", "text", "weight", "rank", "id", "row"}
    assert got.select("row.weight", "row.rank", "row.id", "row.row").distinct().collect() == [(1.5, "a", 7, 8)]
    rows = [tuple(r) for r in got.select("row.doc_id", "n_features", "weight", "score", "rank").collect()]
    want, null_drawn = brute(docs, target, 25, 20, longest, 64)
    assert sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) == want
    assert sum(1 for r in rows if r[0] is None and r[4] is not None) == null_drawn


def test_repeated_rows_share_the_last_places(spark):
    rows = [(7, "same words here " * 10)] * 90 + [(k, "other words there " * 10) for k in range(100, 110)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"))
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, 11)) and got.count() == 100


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    short = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(short, none).collect()] == [None]


@pytest.mark.parametrize("ties", [False, True])
def test_cutoff(spark, monkeypatch, ties):
    monkeypatch.setattr(resampling, "FINISH", 5)
    monkeypatch.setattr(resampling, "PART_KEYS", 37)
    passes = []
    plain = resampling._pass
    monkeypatch.setattr(resampling, "_pass", lambda *a: passes.append(1) or plain(*a))
    rng = random.Random(3)
    keys = [Key(rng.randrange(4) if ties else rng.randrange(-(10**6), 10**6), rng.randrange(3) if ties else k, 0) for k in range(1500)]
    df = spark.createDataFrame(keys, "fall long, id long, tie long").repartition(6).checkpoint()
    for wanted in (1, 2, 150, 751, 1499, 1500):
        passes.clear()
        assert resampling.cutoff(df, wanted) == sorted(keys)[wanted - 1]
        assert len(passes) <= 20  # each but the first discards a quarter or more
