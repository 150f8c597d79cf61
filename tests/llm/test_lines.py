"""Line-first cleaning against plain Python."""

import random
import re

from versionlink.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(5)}
    seen, again, lost = [], 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            continue
        again += line in seen
        seen.append(line)
        odd = sum(1 for w in own if re.search(r"[#*$%&|<>]|[!?]{2}$", w))
        separators = sum(1 for w in own if re.fullmatch("[|»›>•·/–-]+", w) and len(w.encode()) < 4)
        if (
            len(own) < lines.SHORT and not re.search("[.!?:;,\"')\\]}…”’»。！？]$", own[-1])
            or 100 * odd > 30 * len(own) or separators >= 2 and 5 * separators >= len(own)
            or any(p in line.lower() for p in lines.BOILERPLATE)
        ):
            lost += len(own)
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), failed,
            not failed and 100 * lost <= 40 * n)


def made(rng):
    out = []
    for _ in range(rng.randrange(6)):
        kind = rng.random()
        words = [rng.choice(["Öl", "be", "sea", "tree", "näh", "x"]) + str(rng.randrange(50)) for _ in range(rng.randrange(25))]
        if kind < 0.2:
            words = [w + rng.choice(["&&", "!!", "$"]) for w in words]
        elif kind < 0.3:
            words = [w for p in words for w in (p, "|")]
        line = rng.choice([" ", "  ", "\t"]).join(words) + rng.choice([".", "", " ", "»", "\r"])
        out += [line] * rng.choice([1, 1, 2])
    return "\n".join(out)


def test_judge(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\n", "one", "A cookie policy.", "a b c d e f g h i j k. ", "w " * 50_000, "x" * 300_000]
    texts += [made(rng) for _ in range(150)]
    rows = [(k if k else None, t, "src", 5) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)
    got = sorted((tuple(r) for r in lines.judge(df).collect()), key=str)
    skip = {"w " * 50_000: (50_000, 50_000, 0, 0, 50_000, True, False)}
    want = sorted(((k, *(skip.get(t) or brute(t))) for k, t, *_ in rows), key=str)
    assert got == want


def test_clean(spark):
    good = "This line says enough words to stay in the text, surely.\n"
    rows = [(1, good * 1 + "Home | About | News\n" + "It goes on with some other words for a while."), (2, None), (3, "Home | About")]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lines.clean(df).collect()
    assert [r.doc_id for r in kept] == [1]
    assert "Home" not in kept[0].text and kept[0].n_chars == len(kept[0].text) and kept[0].lang == "en"
    assert lines.clean(df.limit(0)).count() == 0 and lines.judge(df.limit(0)).count() == 0
