"""Whole line linkage against plain Python, with parts in one task and as rounds of joins."""

import random

import duckdb
import pytest

import plain_lines
from versionlink.operators.components import connected
from versionlink.plans import lines as ln
from versionlink.queries import fixtures as fx, link

LINES = "path string, line long, code string"


def versions(seed):
    """Files with repeated lines, comments, edits, and passages that moved to other files."""
    rng = random.Random(seed)
    words = ["a = 1", "b += a", "}", "# x", "call(a)", "call(b) // why", "return", "loop", "x" * 12]
    old = {}
    for k in range(9):
        body = [rng.choice(words[: rng.choice([4, 9])]) if rng.random() < 0.6 else f"line {rng.randrange(40)} of text" for _ in range(rng.randrange(1, 22))]
        old[f"s/{k % 3}/f{k}"] = body
    new = {}
    for path, body in old.items():
        kept = []
        for code in body:
            roll = rng.random()
            if roll < 0.1:
                continue
            kept.append(code + " //" + rng.choice("pq") if roll < 0.2 else code.replace("e", "u") if roll < 0.3 else code)
            if rng.random() < 0.1:
                kept.append(rng.choice(words))
        new["new/" + path] = kept
    paths = list(new)
    for _ in range(3):  # moved passages
        a, b = rng.sample(paths, 2)
        at = rng.randrange(len(new[a]) + 1)
        new[b] += new[a][at : at + 6]
        del new[a][at : at + 6]
    new["new/t/f0"] = ["call(a)", "line 1 of text"]
    number = lambda src: {p: [(k, c) for k, c in enumerate(body, 1)] for p, body in src.items() if body}
    return number(old), number(new)


def table(spark, src):
    return spark.createDataFrame([(p, k, c) for p, rows in src.items() for k, c in rows], LINES)


@pytest.mark.parametrize("seed,part_lines", [(1, 20_000), (3, 25)])
def test_all_links(spark, seed, part_lines):
    old, new = versions(seed)
    rng = random.Random(seed)
    listed = [{(p, k) for p, rows in src.items() for k, _ in rows if rng.random() < 0.8} for src in (old, new)]
    frames = [spark.createDataFrame(sorted(x), "path string, line long") for x in listed]
    got = ln.link_lines(table(spark, old), table(spark, new), *frames, part_lines=part_lines)
    log = []
    want = plain_lines.link_lines(old, new, *listed, log)
    assert {tuple(r) for r in got.collect()} == want
    assert sum(1 for kind, *_ in log if kind == "equal") > 3


def test_registered_query_on_the_smallest_tables(spark):
    """``line_link_all`` over all documents of the smallest scale, uncapped, against the plain run."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    sides = []
    for name in ("old_src", "new_src"):
        src = {}
        for p, k, code in con.execute(f"with {fx.EDITED_LINES} select path, line, code from {name} order by path, line").fetchall():
            src.setdefault(p, []).append((k, code))
        sides.append(src)
    listed = [{(p, k) for p, rows in src.items() for k, _ in rows} for src in sides]
    want = plain_lines.link_lines(*sides, *listed)
    assert {tuple(r) for r in link.line_link_all(spark, folder).collect()} == want and len(want) > 1600


def test_connected(spark):
    rng = random.Random(4)
    edges = [(f"n{a:03}", f"n{a + 1:03}") for a in range(40)] + [(f"m{rng.randrange(60):02}", f"m{rng.randrange(60):02}") for _ in range(40)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        part[b] = a
    got = {r.node: r.part for r in connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: root(x) for e in edges for x in e}
    assert connected(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
