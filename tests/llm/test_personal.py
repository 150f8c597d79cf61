"""Base spans against the patterns as stated; the bootstrapped patterns on planted contexts."""

import hashlib
import random
import re

from versionlink.llm import personal

STATED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def stated(text):
    return [(k, *m.span()) for k, p in STATED.items() for m in p.finditer(text or "") if counts(k, m[0])]


def test_base(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y.z_w@q.rs", "@", "1.2.3.4", "0255.1.1.256", "255.255.255.255.1", "4111 1111-1111 1111", "4111111111111111",
             "+1 (414) 555-1791", "+49", "++12", "é", " ", "\n", "-", ".", "word", "7", "33", "(", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"]
    texts = [None, "", " ", "1" * 3000, "a@" + "b." * 5000 + "c", "9.9." * 4000, "4111111111111111 " * 700, "x" * 200_000]
    texts += ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(250)]
    rows = [(k or None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, email string, row int").repartition(3)
    got = {r.doc_id: r for r in personal.find_personal(df).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        want, r = stated(t), got[k]
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == x for s in want) for x in STATED), t[:80]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)


def test_context(spark):
    rng = random.Random(6)
    rows = [(k, f"please ask host 10.{rng.randrange(256)}.{k}.7 for it") for k in range(30)]
    rows += [(100, "please ask host 10.300.2.1 for it"), (101, "room 4512345 is free"), (102, "version 10.300.2.1 is out")]
    rows += [(200 + k, f"room {k}12345 is free") for k in range(9)]
    got = {r.doc_id: r for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_ip == 1 and got[k].n_context == 0 for k in range(30))
    found = got[100].spans.split(":")
    assert found[0] == "context" and rows[30][1][int(found[1]) : int(found[2])] == "10.300.2.1"
    assert got[101].spans == "" and all(got[200 + k].n_context == 0 for k in range(9))
    assert personal.find_personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0
