"""The registered cascade and the whole function linkage against plain Python."""

import random

import duckdb

import plain_functions
from versionlink.plans import functions as fn
from versionlink.queries import fixtures as fx, link

PARTS = ["fid", "func", "namespace", "basename", "parameters", "extension", "chunk", "path"]


def given(folder):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet'")
    rows = con.execute(f"with {fx.FUNCTIONS} select {', '.join(PARTS)}, profiled from funcs").fetchall()
    rows = [dict(zip([*PARTS, "profiled"], r)) for r in rows]
    old, new = ([r for r in rows if r["fid"] % 2 == k] for k in (0, 1))
    return old, new, [(r["fid"], r["func"]) for r in old if r["profiled"]]


def test_registered_queries(spark):
    folder = "/root/testdata/sf0.01"
    old, new, profiled = given(folder)
    rows = lambda df: {(r.old_fid, r.old_func, r.new_fid, r.new_func, r.level) for r in df.collect()}
    assert rows(link.function_cascade(spark, folder)) == plain_functions.once(old, new, profiled)
    assert rows(link.function_links(spark, folder)) == plain_functions.all_links(old, new, profiled)


def test_cascade_on_every_level(spark):
    rng = random.Random(6)
    def rows(first, count):
        out = []
        for k in range(count):
            name, space = rng.choice(["open", "opens", "close", "read"]), rng.choice(["io", "net", "ios"])
            row = {"fid": first + k, "namespace": space, "basename": name, "parameters": rng.choice(["()", "(int)", "(a,b)"]),
                   "extension": rng.choice(["", "cold", ".2"]), "chunk": rng.choice("12"), "path": f"{rng.choice('pq')}/{space}{rng.randrange(3)}.c"}
            out.append(row | {"func": f"{space}::{name}{row['parameters']}#{rng.randrange(60)}~{first + k if rng.random() < 0.7 else ''}"})
        seen = set()
        return [r for r in out if not (r["func"] in seen or seen.add(r["func"]))]
    old, new = rows(0, 40), rows(1000, 40)
    profiled = [(r["fid"], r["func"]) for r in old if r["fid"] % 3]
    table = lambda side: spark.createDataFrame([tuple(r[c] for c in PARTS) + (1,) for r in side], ", ".join(f"{c} {'long' if c == 'fid' else 'string'}" for c in PARTS) + ", line long")
    got = fn.link_functions(table(old), table(new), spark.createDataFrame(profiled, "fid long, func string"))
    got = {(r.old_fid, r.old_func, r.new_fid, r.new_func, r.level) for r in got.collect()}
    want = plain_functions.all_links(old, new, profiled)
    assert got == want and len({l[4] for l in want}) > 4
