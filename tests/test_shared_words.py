"""Word weights of lines between links: by gaps inside tasks, against plain Python."""

import random
from collections import Counter

from versionlink.operators import shared_words
from versionlink.plans import lines as ln

LINES = "path string, line long, code string"
LINKS = ln.LINK_SCHEMA


def versions(seed):
    """Two files each with links at some lines; the lines between hold words, comments, and nothing else."""
    rng = random.Random(seed)
    words = ["a", "b", "a", "long", "word", "x" * 9]
    text = lambda: "  ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", " // why a", " "])
    old = {p: {k: text() for k in range(1, 25)} for p in ("p", "q")}
    new = {"n" + p: {k: text() for k in range(1, 23)} for p in old}
    new["np"][3] = "// only a comment"
    old["p"][2] = "//"
    links = [("p", 5, "np", 4), ("p", 12, "np", 13), ("q", 7, "nq", 9), ("q", 9, "nq", 3)]
    return old, new, links


def weights(old, new, links):
    out = {}
    strip = lambda code: code.split("//")[0]
    shown = lambda code: Counter(" ".join(strip(code).split()).split(" "))

    def gap(line, ends):
        """Nearest links before and after, as (own line, other path, other line)."""
        before, after = [e for e in ends if e[0] < line], [e for e in ends if e[0] > line]
        return max(before, default=None), min(after, default=None)

    for p, rows in old.items():
        for o, a in rows.items():
            ends = [(ol, np, nl) for op, ol, np, nl in links if op == p]
            low, high = gap(o, ends)
            if any(e[0] == o for e in ends) or not (low or high) or (low and high and low[2] >= high[2] - 1):
                continue
            path = (low or high)[1]
            for n, b in new[path].items():
                back = [(nl, op, ol) for op, ol, np, nl in links if np == path]
                if any(e[0] == n for e in back):
                    continue
                before, after = gap(n, back)
                if before and after and before[2] >= after[2] - 1:
                    continue
                inside = (low[2] if low else 0) < n < (high[2] if high else 99) and (before[2] if before else 0) < o < (after[2] if after else 99)
                shared = shown(a) & shown(b)
                if inside and shared:
                    longest = max(len(strip(a)), len(strip(b)))
                    total = sum(len(w) * k for w, k in shared.items())
                    out[p, o, path, n] = round(total / longest, 10) if longest else 0.0
    return out


def table(spark, src):
    return spark.createDataFrame([(p, k, c) for p, rows in src.items() for k, c in rows.items()], LINES)


def test_weights(spark, monkeypatch):
    monkeypatch.setattr(shared_words, "TILE_WORK", 60_000)  # many tiles
    old, new, links = versions(3)
    a, b, m = table(spark, old), table(spark, new), spark.createDataFrame(links, LINKS)
    want = weights(old, new, links)
    rows = ln.word_pairs(a, b, m, 24).collect()
    assert len(rows) == len(want) > 60
    assert {(r.old_path, r.old_line, r.new_path, r.new_line): round(r.len, 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert all(r.old_code == old[r.old_path][r.old_line].split("//")[0] for r in rows)
    bare = ln.word_pairs(a, b, m, 24, codes=False)
    assert bare.columns == [*ln.LINK, "old_at", "new_at", "len"]
    assert sorted(map(tuple, bare.collect())) == sorted((*r[:4], 0, 0, r.len) for r in rows)


def test_words_are_not_shuffled(spark):
    """Words leave no row of their own in the plan; only lines meet."""
    old, new, links = versions(1)
    plan = ln.word_pairs(table(spark, old), table(spark, new), spark.createDataFrame(links, LINKS), 24)._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "Window" not in plan


def test_repeated_lines_count_their_words_together():
    assert shared_words._numbered(["a b a"]) == [{"a": 3, "b": 1}]
    twice = shared_words._Lines([(1, ["a b", "a b"], ["a b", "a b"])])
    assert (twice.line, twice.code, twice.words) == ([1], ["a b"], [{"a": 3, "b": 3}])
    first, second = shared_words._numbered(["a a", "a"])
    assert first["a"] | second["a"] == 7 and first["a"] & second["a"] == 0
