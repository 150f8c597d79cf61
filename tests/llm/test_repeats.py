"""Removal of repeated windows against plain Python."""

import hashlib
import random
import re

from versionlink.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def brute(rows, length):
    """Rows are (id, text); equal rows are one document."""
    texts = {(k if k is not None else LAST, t): WORD.findall(t or "") for k, t in rows}
    first = {}
    for (k, t), words in texts.items():
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            first[w] = min(first.get(w, (LAST + 1, 0)), (k, i))
    out = []
    for k, t in rows:
        words = texts[(k if k is not None else LAST, t)]
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (k if k is not None else LAST, i):
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_cover():
    differences = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert differences == set(range(repeats.PERIOD))


def test_repeats(spark):
    rng = random.Random(7)
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.choice([15, 20, 21, 33, 70]))] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n \t"), (3, "few words"), (4, "w " * 500), (None, "w " * 30)]
    for k in range(150):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"ö{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        rows.append((10 + k, rng.choice([" ", "  ", "\n", "\x0b"]).join(words)))
    rows += [rows[20], rows[20], (4000, " ".join(f"u{k}" for k in range(30_000)))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, bucket int").repartition(4)
    want = brute(rows, 20)
    for size in (1 << 24, 2_000):  # one bucket, and many
        assert sorted((tuple(r) for r in repeats.without_repeats(df, bucket_bytes=size).collect()), key=str) == want


def test_small_tasks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH", 30)
    said = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{k} {said} {k}") for k in range(40)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 20)
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
