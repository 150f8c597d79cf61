"""Documents whose own columns are named like an operator's."""

import random

from versionlink.llm import lines, minhash, sampling
from versionlink.llm.common import wide_key

NAMES = ["_p", "_m", "_c", "_cut", "_place", "_whole", "fraction", "_size", "_u", "_q", "_measure", "_part", "_fine", "_source_size",
         "_target", "_copies", "size", "copies", "target", "turn", "_turn", "row", "_row", "rows", "_rows", "doc", "label", "class", "n", "first"]


def table(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(12)]
    rows = [(k, base[k % 12], f"s{k % 3}") for k in range(30)] + [(5, base[5], "s2"), (5, "another text under this id", "s0"), (None, base[1], None), (40, None, "s0")]
    own = {c: k for k, c in enumerate(NAMES)}
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in NAMES)
    return spark.createDataFrame([(*r, *own.values()) for r in rows], schema), own, rows


def check_own(df, own):
    assert set(NAMES) <= set(df.columns)
    assert [tuple(r) for r in df.select(*[f"`{c}`" for c in NAMES]).distinct().collect()] == [tuple(own.values())]


def test_mix(spark):
    df, own, rows = table(spark)
    plain = df.select("doc_id", "text", "source")
    mixed = sampling.mix(df)
    assert mixed.columns == df.columns
    check_own(mixed, own)
    key = lambda d: sorted(d.select("doc_id", "text", "source").collect(), key=str)
    assert key(mixed) == key(sampling.mix(plain))
    counted = sampling.with_copies(df)
    check_own(counted, own)
    assert counted.columns[len(df.columns):] == ["__size", "__source_size", "__target", "__copies"]
    assert sampling.with_copies(plain).columns[3:] == ["_size", "_source_size", "_target", "_copies"]


def test_keep_one(spark):
    df, own, rows = table(spark)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    check_own(kept, own)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(k, t) for k, t, _ in rows[:12]] + [(5, "another text under this id"), (None, rows[1][1]), (40, None)]
    assert got == sorted(want, key=str)


def test_clean(spark):
    df, own, _ = table(spark)
    cleaned = lines.clean(df)
    assert cleaned.columns == df.columns


def test_wide_key(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (1, ""), (None, "a"), (None, None), (11, "a"), (1, "1a"), (None, "-"), (1, "-")]
    keys = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(wide_key()).collect()]
    assert len(set(keys)) == len(set(rows)) and all(len(k) == 16 for k in keys)
