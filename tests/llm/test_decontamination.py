"""Planted passages, whole, edited and in part; banded alignment against the full table."""

import random

from versionlink.llm import decontamination as d


def distance_in(segment, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(segment, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_alignment():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(40))
        at = rng.randrange(20)
        segment = bytearray(text[at : at + 15])
        for _ in range(rng.randrange(4)):
            segment[rng.randrange(len(segment))] = rng.choice(b"abc")
        want = distance_in(bytes(segment), text)
        got = d.edits_within(bytes(segment), text, -20, 45, 6)
        assert got == (want if want <= 6 else None)


def test_leaks(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, 40).capitalize() + ".") for k in range(30)] + [(90, None), (91, ""), (92, "short one"), (93, "É" * 5)]
    docs, want = [], set()
    for k in range(200):
        host = prose(rng, rng.randrange(5, 300))
        if k % 4 == 0:
            item = rng.randrange(30)
            text = list(items[item][1])
            for _ in range(rng.choice([0, 0, 2])):
                text[rng.randrange(len(text))] = rng.choice("xyz")
            said = "".join(text)
            if k % 8 == 0:
                said = said[len(said) // 4 :]
            host = f"{host[: len(host) // 2]}\n\n{said.upper() if k % 3 else said.replace(' ', '  ')} {host[len(host) // 2 :]}"
            want.add((k, item))
        docs.append((k, host))
    docs += [(1000, None), (1001, ""), (1002, " " * 50), (None, items[3][1]), (None, items[3][1]), (1003, prose(rng, 40_000))]
    want |= {(None, 3)}
    df = spark.createDataFrame([(*r, 7, "t") for r in docs], "doc_id long, text string, item_id int, edits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want) + 1  # the repeated row is told twice
    kept = d.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in docs} - {k for k, _ in want})


def test_parts_and_empty(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, prose(rng, 40)) for k in range(12)]
    docs = spark.createDataFrame([(k, "see " + t) for k, t in items] + [(50, prose(rng, 50))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    monkeypatch.setattr(d, "PART_BYTES", 600)
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()} == whole == {(k, k) for k in range(12)}
    assert [r.doc_id for r in d.without_leaks(docs, bench).collect()] == [50]
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.without_leaks(docs, bench.limit(0)).count() == 13
    assert d.leaks(docs.limit(0), bench).count() == 0
