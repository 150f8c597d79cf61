"""Base spans against the patterns as stated; the field against enumeration; tagging of unseen forms."""

import hashlib
import itertools
import random
import re

import numpy as np

from versionlink.llm import secrets

STATED = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}


def stated(text):
    out = []
    for kind, pattern in STATED.items():
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(STATED).index(s[0])))


def texts():
    rng = random.Random(2)
    parts = ["token = \"", "API_KEY:", "apikey=", "Secret'  :  '", "passwd", "pass", "AKIA", "AKIAAKIA", "é", "\n", " ", " and ",
             "password=short", "=", "."]
    out = [None, "", " ", "token=" + "a" * 12, "token=" + "a" * 11]
    for _ in range(200):
        pieces = []
        for _ in range(rng.randrange(12)):
            pieces.append(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choices("0123456789abcdefXYZ", k=rng.randrange(1, 30))))
        out.append("".join(pieces))
    return out


def test_base(spark):
    rows = [(k or None, t, "x") for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = {}
    for r in secrets.find_secrets(df).collect():
        got[r.doc_id] = r
    for k, t, _ in rows:
        want = stated(t)
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        r = got[k]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == x for s in want) for x in STATED)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_viterbi_and_pieces():
    rng = np.random.default_rng(1)
    field = secrets.Field(rng.normal(size=(len(secrets.FEATURES), 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    masks = rng.integers(0, 1 << len(secrets.FEATURES), 6)

    def score(tags):
        s = field.scores(masks)
        return field.first[tags[0]] + sum(s[t, a] for t, a in enumerate(tags)) + sum(
            field.step[a, b] for a, b in itertools.pairwise(tags))

    best = max(itertools.product(range(3), repeat=6), key=score)
    assert tuple(field.decode(masks, True)) == best
    sure = field._replace(emit=field.emit + np.array([[1.0, 0, 0]]))
    long = np.random.default_rng(2).integers(0, 1 << len(secrets.FEATURES), 300)
    whole, cut = sure.decode(long, True), np.zeros(300, int)
    for low, high in secrets._pieces(sure, long):
        cut[low:high] = sure.decode(long[low:high], low == 0)
    assert np.array_equal(whole, cut) and len(secrets._pieces(sure, long)) >= 1


def test_field_learns_and_adds(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "river", "goes", "over", "old", "stones", "slowly."]) for _ in range(n))
    signs = "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    make = lambda: "".join(rng.choices(rng.choice([signs, "0123456789abcdef"]), k=rng.randrange(24, 48)))
    rows = [(k, f'{prose(30)} token = "{make()}" {prose(20)}') for k in range(150)] + [(200 + k, prose(60)) for k in range(100)]
    unseen = "".join(rng.choices(signs, k=40))
    rows += [(900, f'{prose(10)} credential = "{unseen}" {prose(10)}'), (901, prose(20_000)), (902, None)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_assign == 1 for k in range(150))
    assert not any(got[200 + k].spans for k in range(100)) and got[901].spans == "" and got[902].spans == ""
    text = dict(rows)[900]
    assert any(
        unseen in text[int(s):int(e)] for kind, s, e in (x.split(":") for x in got[900].spans.split(",") if x) if kind == "tagged"
    )
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
