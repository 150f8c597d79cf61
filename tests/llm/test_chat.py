"""Round trips of the packs, and what the tokens of a pack may see."""

import hashlib
import os
import random

import pytest

from versionlink.llm import chat


def told(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def made():
    rng = random.Random(9)
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\<|", "<|\\", "a\\|>b", "<\\|end|>", "", None, "ünï\n\n", "<<SYS>>|>"]
    out = {}
    for k in range(120):
        turns = [("system", "be kind"), ("user", rng.choice(["same question", "other"]))] if k % 3 else []
        for _ in range(rng.randrange(1, 6)):
            turns.append((rng.choice(["user", "assistant", "assistant", None, "a|>b", "<|end|>"]), rng.choice(nasty)))
        out[k] = turns
    out[500] = out[501] = out[7]
    out[600] = [("user", "x" * 3_000)] * 40
    return out


def rows(said):
    return [(k, at, r, t, 0) for k, turns in said.items() for at, (r, t) in enumerate(turns)]


def test_escape():
    for text in ["", "\\", "<|", "<\\|", "<<|", "<|>", "</s>\\", "[[INST]", "<\\\\|"]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_round_trip(spark):
    said = made()
    df = spark.createDataFrame(rows(said), "conv_id long, turn long, role string, text string, tokens int").repartition(5)
    for size in (1 << 16, 500):
        packs = chat.packs(df, size=size)
        got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(packs).collect()}
        assert got == {k: told(turns) for k, turns in said.items()}


def test_shared_turns_once_and_intervals(spark):
    said = {1: [("user", "hi"), ("assistant", "a")], 2: [("user", "hi"), ("assistant", "b"), ("user", "c")], 3: [("user", "hi")]}
    df = spark.createDataFrame(rows(said), "conv_id long, turn long, role string, text string, x int").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        packs = chat.packs(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(packs) == 1
    pack = packs[0]
    text = "".join(map(chr, pack.tokens))
    assert text.count("hi") == 1 and len(pack.nodes) == 4
    for node in pack.nodes:
        seen = sum(x.end - x.start for x in node.attends)
        assert node.position == seen  # positions count what is seen before
        if node.parent >= 0:
            up = pack.nodes[node.parent]
            assert any(x.start <= up.start and up.end <= x.end for x in node.attends)
    cousins = [n for n in pack.nodes if n.role == "assistant"]
    assert not any(x.start < cousins[0].end and cousins[0].start < x.end for x in cousins[1].attends)
    assert sorted(text[x.start : x.end] for x in pack.loss) == ["a", "b"]


def test_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.packs(spark.createDataFrame([], schema)).count() == 0
    odd = [(None, 0, "user", "x"), (4, None, None, None), (4, 1, "assistant", "y"), (4, 1, "assistant", "y")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.packs(spark.createDataFrame(odd, schema))).collect()}
    assert got[None] == told([("user", "x")])
    assert got[4] == told([("", ""), ("assistant", "y"), ("assistant", "y")])
    probe = chat.read_back(chat.packs(chat.probe(spark))).first()
    assert probe.conv_id == -7 and probe.loss_chars == len("</s>[INST] ok [/INST]")


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary file")
def test_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    said = {1: [("user", "hello there <|endoftext|>"), ("assistant", "ünï code")], 2: [("user", "hello there <|endoftext|>")]}
    df = spark.createDataFrame(rows(said), "conv_id long, turn long, role string, text string, x int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.packs(df, tokenizer=path), path).collect()}
    assert got == {k: told(v) for k, v in said.items()}
