"""Spelling variants against all pairs of words, and the index against plain search."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from versionlink.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(rows):
    n = counted(rows)
    near = {w: [u for u in n if one_edit(w, u)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda u: (-n[u], u))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def words(rng, count):
    syllables = ["ba", "ko", "ri", "men", "tal", "dó", "ÿs", "lin", "×a", "sto"]
    out = {"".join(rng.choice(syllables) for _ in range(rng.randrange(3, 6))) for _ in range(count)}
    for w in list(out):
        for _ in range(3):
            k = rng.randrange(len(w))
            out.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeó") + w[k:], w[:k] + "x" + w[k + 1 :]]))
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("piece", [5_000, 7])
def test_variants(spark, piece):
    rng = random.Random(9)
    vocabulary = words(rng, 60) + ["aaaaaaa", "aaaaaaaa", "aaaaaab", "prefixaa", "prefixab", "prefixba", "b" * 300, "b" * 299]
    rows = [(0, None), (1, ""), (2, "1 2 !"), (None, "Aaaaaaa aaaaaaa")]
    for k in range(200):
        rows.append((10 + k, rng.choice([" ", "7", "\n", "-"]).join(
            rng.choice(vocabulary[: rng.choice([3, 10, 400])]).upper() if rng.random() < 0.2 else rng.choice(vocabulary[: rng.choice([3, 10, 400])])
            for _ in range(rng.randrange(80)))))
    rows += [rows[20], rows[20], (999, " ".join(vocabulary * 400))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.variants(df, piece=piece)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert any(r[4] for r in want) and any(r[1] for r in want)


def test_chains_end_at_the_last_form(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:])] + [("zzzzzzz", None)], "word string, form string")
    assert {tuple(r) for r in spelling._roots(rows).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_states_are_occurrences_in_both_directions():
    index = spelling.BidirectionalIndex(["banana", "bandana", "ananas"])
    text = "".join("$" + w for w in ["banana", "bandana", "ananas"])
    turns = text + text
    for pattern in ("an", "na$b", "ana", "dan", "s$ba"):
        for order in ("right", "left", "both"):
            state = (np.array([0]), np.array([0]), np.array([index.size]))
            middle = {"right": 0, "left": len(pattern), "both": len(pattern) // 2}[order]
            for c, right in [(c, True) for c in pattern[middle:]] + [(c, False) for c in reversed(pattern[:middle])]:
                symbol = 0 if c == "$" else index.symbol[c]
                state = tuple(a[:, symbol] for a in index.steps(*state, right))
            low, mirror, count = (int(a[0]) for a in state)
            places = sorted(i for i in range(len(text)) if turns[i : i + len(pattern)] == pattern)
            assert sorted(index.sides[False].order[low : low + count].tolist()) == places
            ends = sorted(len(text) - 1 - (i + len(pattern) - 1) % len(text) for i in places)
            assert sorted(index.sides[True].order[mirror : mirror + count].tolist()) == ends


def test_both_searches_find_every_near_word():
    rng = random.Random(11)
    held = words(rng, 120)
    index = spelling.BidirectionalIndex(held)
    want = {(a, b) for a in held for b in held if one_edit(a, b)}
    right = {(held[q], held[w]) for q, w in zip(*spelling.near_words(index, held, True))}
    left = {(held[q], held[w]) for q, w in zip(*spelling.near_words(index, held, False))}
    assert right | left == want
    assert all(b.startswith(a[: len(a) // 2]) for a, b in right)
    assert all(b.endswith(a[len(a) // 2 :]) for a, b in left)
