"""Near-duplicates against a comparison of all pairs."""

import random
import re

from versionlink.llm import minhash
from versionlink.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets.append(runs)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least, doc_id is not None and doc_id == least))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c"), (None, "a b c"), (None, "x")]
    for group in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 + len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    rows.append(rows[-1])
    rows.append((10 + len(rows), "long " + " ".join(rng.choice(words) for _ in range(30_000))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as row", "'k' as key")
    for percent in (80, 85):
        assert found(minhash.near_duplicates(df.repartition(3), percent)) == brute(rows, percent)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    assert minhash.keep_one(df).count() == 0


def test_keep_one(spark):
    same = " ".join(f"w{k}" for k in range(50))
    rows = [(3, same, "x"), (1, same, "x"), (1, same, "x"), (2, "other", "x"), (None, same, "x")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in kept.collect()]))
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 2, None]


def test_match_bound():
    for percent in (80, 85, 95):
        assert 1 <= minhash.least_matches(percent) <= 32
    assert minhash.least_matches(85) > minhash.least_matches(80)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
