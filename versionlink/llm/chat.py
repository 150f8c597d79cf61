"""Chat formatting as prefix trees: shared first turns are emitted once.

The template writes a turn as ``<|role|>\\n``, its text, ``<|end|>\\n``. Inside roles and texts a
backslash is doubled and every control string of ``CONTROLS`` gets a backslash behind
its first letter, so no text can pose as a mark; ``unescape`` reverses both.

Conversations are sorted by the hashes of their turns, so those that share first
turns are neighbours, and consecutive ones are merged into trees until a pack
holds ``PACK`` tokens. A pack is one row: its tokens depth-first, the nodes (turns)
with their place, parent, first position id and the intervals of earlier tokens
they may attend to (all ancestors, then the node itself causally), the loss
intervals (assistant texts), and the node at which each conversation ends. The
sort is a range partition of whole paths and ids, so a first turn that a third of
all conversations share is spread over many tasks; each pack repeats the shared turns
at most once.

Tokens are code points, or the ids of a byte-level vocabulary file given as
``tokenizer``; then every piece (mark, text) is encoded by itself.

Row cases: null text and null role are empty. Turns are ordered by ``turn`` (null
first), then role and text; repeated rows are repeated turns. Null ``conv_id`` is a
conversation of its own. One conversation is one sequence and one row, whatever its
length. An empty table gives no packs; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches

CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
PACK = 1 << 16
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)  # also overlapping ones
_TURN = re.compile(r"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)

_SPAN = "array<struct<start:int,end:int>>"
PACKS = (
    "tokens array<int>, nodes array<struct<role:string,parent:int,start:int,end:int,position:int,"
    f"attends:{_SPAN}>>, loss {_SPAN}, ends array<struct<conv_id:bigint,node:int>>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _encoder(tokenizer: str | None) -> Callable[[str], list[int]]:
    if tokenizer is None:
        return lambda text: list(map(ord, text))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True
    return lambda text: model.encode(text, add_special_tokens=False).ids


def _decoder(tokenizer: str | None) -> Callable[[list[int]], str]:
    if tokenizer is None:
        return lambda ids: "".join(map(chr, ids))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    return lambda ids: model.decode(ids, skip_special_tokens=False)


class _Tree:
    """Conversations merged by their first turns, and the pack they make."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.size = encode, 0
        self.children: list[dict] = [{}]
        self.turns: list[tuple] = [()]
        self.ends: list[list] = [[]]

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        at = 0
        for role, text in turns:
            found = self.children[at].get((role, text))
            if found is None:
                mark = self.encode(f"<|{escape(role)}|>\n")
                body, end = self.encode(escape(text)), self.encode("<|end|>\n")
                found = len(self.turns)
                self.children[at][(role, text)] = found
                self.turns.append((role, mark, body, end))
                self.children.append({})
                self.ends.append([])
                self.size += len(mark) + len(body) + len(end)
            at = found
        self.ends[at].append(conv_id)

    def pack(self) -> dict:
        tokens, nodes, loss, ends = [], [], [], [{"conv_id": c, "node": -1} for c in self.ends[0]]
        stack = [(k, -1, 0, []) for k in reversed(self.children[0].values())]
        while stack:
            k, parent, position, attends = stack.pop()
            role, mark, body, end = self.turns[k]
            start = len(tokens)
            tokens += mark + body + end
            if role == LEARNED:
                loss.append({"start": start + len(mark), "end": start + len(mark) + len(body)})
            me = len(nodes)
            nodes.append({"role": role, "parent": parent, "start": start, "end": len(tokens), "position": position,
                          "attends": attends})
            ends += [{"conv_id": c, "node": me} for c in self.ends[k]]
            last = attends[-1] if attends else None
            if last and last["end"] == start:  # the parent's tokens stand right before
                inner = [*attends[:-1], {"start": last["start"], "end": len(tokens)}]
            else:
                inner = [*attends, {"start": start, "end": len(tokens)}]
            below = position + len(tokens) - start
            stack += [(c, me, below, inner) for c in reversed(self.children[k].values())]
        return {"tokens": tokens, "nodes": nodes, "loss": loss, "ends": ends}


def packs(conversations: DataFrame, size: int = PACK, tokenizer: str | None = None) -> DataFrame:
    """The packs (see ``PACKS``) of ``conv_id, turn, role, text`` rows."""
    small_batches(conversations.sparkSession)
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("turn")
    )
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumn(
        "path", F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    )
    whole = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        schema = _arrow_schema()
        tree = _Tree(encode)
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree.add(conv_id, [(t["role"], t["text"]) for t in turns.as_py()])
                if tree.size >= size:
                    yield pa.RecordBatch.from_pylist([tree.pack()], schema)
                    tree = _Tree(encode)
        if tree.size or tree.ends[0]:
            yield pa.RecordBatch.from_pylist([tree.pack()], schema)

    return whole.select("conv_id", "turns").mapInArrow(run, PACKS)


def _arrow_schema() -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    node = pa.struct([("role", pa.string()), ("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                      ("position", pa.int32()), ("attends", span)])
    ends = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
    return pa.schema([("tokens", pa.list_(pa.int32())), ("nodes", pa.list_(node)), ("loss", span),
                      ("ends", pa.list_(ends))])


def conversation(tokens: list[int], nodes: list[dict], node: int) -> list[tuple[int, int]]:
    """The token intervals that make up the conversation ending at ``node``, in order."""
    if node < 0:
        return []
    own = nodes[node]
    return [(x["start"], x["end"]) for x in own["attends"]] + [(own["start"], own["end"])]


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation the digests of its turns and of the text under the loss mask, from the packs alone."""
    small_batches(formatted.sparkSession)

    def run(batches):
        decode = _decoder(tokenizer)
        for batch in batches:
            for k in range(batch.num_rows):  # one pack at a time as Python objects
                pack = batch.slice(k, 1).to_pylist()[0]
                rows = [_digest(pack, end, decode) for end in pack["ends"]]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                ]))

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest(pack: dict, end: dict, decode) -> dict:
    tokens, spans = pack["tokens"], conversation(pack["tokens"], pack["nodes"], end["node"])
    text = "".join(decode(tokens[a:b]) for a, b in spans)
    turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
    learned = []
    for a, b in spans:
        learned += [unescape(decode(tokens[x["start"] : x["end"]])) for x in pack["loss"]
                    if a <= x["start"] and x["end"] <= b]
    loss = "".join(learned)
    told = "".join(f"{role}\n{body}\n" for role, body in turns)
    return {
        "conv_id": end["conv_id"], "n_turns": len(turns),
        "turns_sha256": hashlib.sha256(told.encode()).hexdigest(), "loss_chars": len(loss),
        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text),
    }


def probe(spark: SparkSession) -> DataFrame:
    """A conversation that consists of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
