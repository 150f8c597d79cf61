"""The pattern graph against plain Python, long words, and held-out seeds."""

import math
import random
import time

from versionlink.llm import personal


def plain(edges, rounds, confident, support, focus):
    """edges: {(pattern, value): seed}; a pattern is (words, shape)."""
    held = {}
    for (p, v), seed in edges.items():
        held.setdefault(p, {})[v] = seed
    beside = {}
    for p, own in held.items():
        beside[p[0]] = beside.get(p[0], 0) + len(own)
    held = {p: own for p, own in held.items() if len(own) >= support and len(own) >= focus * beside[p[0]]}
    of = {}
    for p, own in held.items():
        for v in own:
            of.setdefault(v, []).append(p)
    score = {(p, v): float(seed) for p, own in held.items() for v, seed in own.items()}
    for turn in range(rounds):
        trust = {p: round(sum(score[p, v] for v in own) / len(own), 9) for p, own in held.items()}
        worth = {p: round(sum(score[p, v] for v in own), 6) for p, own in held.items()}
        if turn == rounds - 1:
            return {p for p in held if trust[p] >= confident and worth[p] >= support}
        good = {p for p in held if worth[p] >= support and trust[p] > 0}
        for v, patterns in of.items():
            open_ = math.prod(max(1 - trust[p], 1e-9) for p in patterns if p in good)
            for p in patterns:
                score[p, v] = 1.0 if held[p][v] else round(1 - open_, 9)


def test_graph(spark):
    rng = random.Random(8)
    edges = {}
    for k in range(900):
        words, shape = f"before w{min(rng.randrange(40), rng.randrange(40))}", rng.choice(["a@a.a", "A.A.A.A", "D", "B"])
        value = f"{shape}{rng.randrange(250)}"
        edges[(words, shape), value] = rng.random() < 0.9 if int(words[8:]) % 3 else rng.random() < 0.3
    seeds = {}  # a value is a seed or not, wherever it stands
    for (p, v), seed in edges.items():
        edges[p, v] = seeds.setdefault(v, seed)
    rows = [((words, shape), v, seed) for ((words, shape), v), seed in edges.items()]
    df = spark.createDataFrame(rows * 2, "pattern struct<words:string,shape:string>, value string, seed boolean")
    for focus in (0.0, 0.3):
        got = {tuple(r.pattern) for r in personal.confident_patterns(df, 3, 0.7, 3.0, focus).collect()}
        want = plain(edges, 3, 0.7, 3.0, focus)
        assert got == want and want
    assert plain(edges, 3, 0.7, 3.0, 0.3) < plain(edges, 3, 0.7, 3.0, 0.0)


def test_words_that_stand_everywhere_say_nothing(spark):
    rows = [(k, f"the amount of {4111111111111111 if k % 2 else 40000 + k} and of user{k}@mail.org of {k}.5.5.{k} was") for k in range(20)]
    rows += [(50 + k, f"mailbox user{k}@post.org today") for k in range(20)] + [(99, "mailbox user_x@local today"), (98, "of 123456789012345678 was")]
    got = {r.doc_id: r for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[98].n_context == 0
    assert got[99].n_context == 0  # its shape is another one


def test_long_words(spark):
    million = 1_000_000
    texts = ["a" * million + " a@b.cd", "a.b+c%" * (million // 6), "a@b.c_" * 50_000, "1" + "#" * million + "1", "+@" * 100_000, "=" * million + "7"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    began = time.time()
    got = {r.doc_id: r for r in personal.find_personal(df).collect()}
    assert time.time() - began < 120
    assert got[0].n_email == 1 and got[0].spans == f"email:{million + 1}:{million + 7}"
    assert got[2].n_email == 50_000 and got[2].spans.startswith("email:0:5,email:5:11,email:11:17")
    assert sum(got[k].n_email for k in (1, 3, 4, 5)) == 0


def test_held_out_seeds_are_found_again(spark, monkeypatch):
    """Addresses whose form fails the base pattern, in the contexts of those that pass."""
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["river", "stone", "green", "house", "walks"]) for _ in range(rng.randrange(3, 9)))
    rows, hidden = [], []
    for k in range(200):
        octet = 300 if k % 4 == 0 else 10  # 300 fails the base pattern
        text = f"{fill()} reachable at {octet}.{k}.7.{k % 9} via {fill()}"
        rows.append((k, text))
        hidden += [k] * (octet == 300)
    rows += [(1000 + k, f"{fill()} costs {rng.randrange(10**6, 10**7)} in {fill()}") for k in range(100)]
    got = {r.doc_id: r.n_context for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), confident=0.7).collect()}
    assert sum(got[k] for k in hidden) == len(hidden)  # recall
    assert sum(got.values()) == len(hidden)  # precision
