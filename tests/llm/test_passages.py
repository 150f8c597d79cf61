"""Parts of benchmark items: middle passages, clustered edits and short items against brute force."""

import random

import pytest
from test_decontamination import distance_in, prose

from versionlink.llm import decontamination as d


def found(items, text):
    return {k for _, k, _, _ in d.find(d.index(list(enumerate(items))), [text.encode()])}


@pytest.mark.parametrize("size", [71, 77, 92, 130])
def test_middle_passages(size):
    rng = random.Random(size)
    item = prose(rng, 40)
    for at in range(0, len(item) - size + 1, 3):
        part = item[at : at + size].strip()
        if len(part) == size:
            assert found([item], f"{prose(rng, 30)} {part} {prose(rng, 30)}") == {0}, at


def test_one_replaced_word():
    rng = random.Random(4)
    for size in (80, 100, 140, 200, 260, 400):
        for _ in range(20):
            item = prose(rng, 100)[:size].rstrip()
            w = len(item) * 5 // 100
            at = rng.randrange(len(item) - w)
            said = item[:at] + "z" * w + item[at + w :]  # the edits stand together
            assert found([item], f"{prose(rng, 20)} {said} {prose(rng, 20)}") == {0}, (size, at)


def test_against_brute_force():
    rng = random.Random(5)
    items = [prose(rng, n) for n in (6, 7, 9, 12, 14, 18, 25)]
    for _ in range(40):
        k = rng.randrange(len(items))
        said = bytearray(items[k].encode())
        at = rng.randrange(len(said))
        for _ in range(rng.randrange(12)):
            said[min(len(said) - 1, max(0, at + rng.randrange(-6, 7)))] = rng.choice(b"xyz")
        text = prose(rng, 10) + " " + said.decode() + " " + prose(rng, 10)
        code = d.normal(text.encode()).tobytes()
        want = set()
        for j, item in enumerate(items):
            for m in [n for n in d.LENGTHS if n <= len(item)] or [len(item)]:
                starts = {*range(0, len(item) - m, d.STEP), len(item) - m}
                if any(distance_in(item[a : a + m].encode(), code) <= d.allowed(m) for a in starts):
                    want.add(j)
                    break
        assert found(items, text) == {j for j in want if len(items[j]) >= d.LEAST} | {
            j for j, item in enumerate(items) if len(item) < d.LEAST and f" {item} ".encode() in b" " + code + b" "}


def test_short_items():
    items = ["What is 2+2?", "Paris", "É!", "", "  ", "Paris"]
    assert found(items, "he asked: what is\n2 + 2") == {0}
    assert found(items, "PARIS") == {1, 5}
    assert found(items, "in paris, é") == {1, 2, 5}
    assert found(items, "comparison of parison") == set()
    assert found(items, "") == set()
