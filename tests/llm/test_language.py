"""Held-out accuracy, and profiles against vectors built letter by letter."""

import random
import zlib

import numpy as np

from versionlink.llm import language


def test_bundle_is_the_sum_of_bound_vectors():
    space = language.Space(width=64)
    text = "Ab, ça 12 b!"
    grams, counts = space.grams(text.encode())
    letters = [0] + [language._letter_codes()[ord(c)] for c in "ab "] + [language._letter_codes()[ord(c)] for c in "ça "]
    letters += [language._letter_codes()[ord(c)] for c in "b "]
    want = np.zeros(64)
    for i in range(len(letters) - 2):
        bound = np.ones(64)
        for k in range(3):
            bound *= space.placed[k][letters[i + k]]
        want += bound
    assert np.array_equal(space.bundle(grams, counts), want)
    both = dict(zip("ab", space.bundles([(grams, counts), (grams[:1], counts[:1])])))
    assert np.array_equal(both["a"][1], want) and both["b"][0] == 1


def test_accuracy_and_cases(spark):
    rng = random.Random(5)
    syllables = {"xx": ["ka", "to", "mi", "ré"], "yy": ["schl", "ung", "ber", "öf"], "zz": ["да", "не", "ко", "при"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(syllables))
        rows.append((k, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(3, 60))), lang))
    odd = [(1000, None, "xx"), (1001, "12 34 !", "yy"), (None, "kato miré", None), (1002, "x" * 400_000, None), (1003, "", "zz")]
    df = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string").repartition(3)
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    held = [(got[k], lang) for k, _, lang in rows if got[k].held_out]
    assert len(held) > 80 and sum(r.lang_pred == lang for r, lang in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("xx", "yy", "zz", "und") for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1003)] == ["und"] * 3 and got[None].lang_pred == "xx"
    nothing = language.identify(df.filter("doc_id >= 1000 and doc_id <> 1002")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, f"kato miré {k}", "xx") for k in range(40)]
    poison = [(k, "schlung beröf", "bad") for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2]
    df = spark.createDataFrame(rows + poison, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df).collect()} == {"xx"}
