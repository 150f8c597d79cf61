"""Line-first cleaning: judge every line, remove the failures, then judge what was lost.

A line (between line feeds, with a word) is removed when one of these holds:

* punctuation: under ``SHORT`` words and no closing mark at its end;
* symbols: over ``SYMBOL_PERCENT`` of its words hold one of ``# * $ % & | < >`` or
  end in a doubled ``!`` or ``?``;
* navigation: two or more words that are only separators, a fifth of all;
* boilerplate: one of the phrases of ``BOILERPLATE``.

A document is rejected when it has under ``LEAST_WORDS`` words, when over
``REPEAT_PERCENT`` of its words lie in five-word windows that occur twice, or when
its removed lines hold over ``LOST_PERCENT`` of its words.

Row cases: null text counts as empty and is rejected for its length. Every row is
judged alone, so repeated rows get equal verdicts and a table without rows gives
none. Words are byte strings of the whole text; lines are equal only as they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, text_blocks
from versionlink.llm.hashing import SPACE, Words

LEAST_WORDS = 10
REPEAT_PERCENT = 20
LOST_PERCENT = 40
SHORT = 10
SYMBOL_PERCENT = 30
WINDOW = 5
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "enable javascript", "licensed under", "lorem ipsum", "click here", "sign up", "log in to", "subscribe to",
)
CLOSING = tuple(c.encode() for c in ".!?:;,\"')]}…”’»。！？")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_START = np.array([(b & 0xC0) != 0x80 and not SPACE[b] for b in range(256)], np.int64)
_ODD = re.compile(rb"[#*$%&|<>]|[!?]{2}$")
_MAY_BE_ODD = re.compile(rb"[#*$%&|<>]|[!?]{2}")
_SEPARATOR = re.compile(b"(?:" + b"|".join(re.escape(c.encode()) for c in "|»›>•·/–-") + b")+")
_PHRASE = re.compile(b"|".join(p.encode() for p in BOILERPLATE))


def _fails(line: bytes, words: list[bytes]) -> bool:
    n = len(words)
    if n < SHORT and not words[-1].endswith(CLOSING):
        return True
    if _MAY_BE_ODD.search(line) and 100 * sum(1 for w in words if _ODD.search(w)) > SYMBOL_PERCENT * n:
        return True
    separators = sum(1 for w in words if len(w) < 4 and _SEPARATOR.fullmatch(w))
    return separators >= 2 and 5 * separators >= n or _PHRASE.search(line.lower()) is not None


def _lines(text: bytes) -> tuple[int, int, list[bytes]]:
    """Equal later lines, words in removed lines, and the lines that stay."""
    seen, again, lost, stay = set(), 0, 0, []
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again += line in seen
        seen.add(line)
        if _fails(line, words):
            lost += len(words)
        else:
            stay.append(line)
    return again, lost, stay


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """Words inside windows that occur more than once."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(n_words + 1, np.int64)
    twice = np.union1d(order[1:][same], order[:-1][same])
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def _judge(texts: list[bytes]) -> tuple[dict[str, list], list[bytes]]:
    words = Words(texts)
    windows = words.windows(words.hashes(), WINDOW)
    total = {k: np.concatenate([[0], np.cumsum(t[words.data])]) for k, t in (("c", _START), ("s", _SYMBOL))}
    low, high = words.text_starts[:-1], words.text_starts[1:] - 1
    out = {
        "n_words": words.counts.tolist(), "word_chars": (total["c"][high] - total["c"][low]).tolist(),
        "n_symbols": (total["s"][high] - total["s"][low]).tolist(),
        "n_dup_lines": [], "n_repeat_words": [], "base_failed": [], "kept": [],
    }
    clean = []
    for k, text in enumerate(texts):
        n = int(words.counts[k])
        repeated = _repeated(windows[words.of_windows(k, WINDOW)], n)
        again, lost, stay = _lines(text)
        failed = n < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * n
        out["n_dup_lines"].append(again)
        out["n_repeat_words"].append(repeated)
        out["base_failed"].append(failed)
        out["kept"].append(not failed and 100 * lost <= LOST_PERCENT * n)
        clean.append(b"\n".join(stay))
    return out, clean


def judge(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, the counts and ``kept``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in text_blocks(batches):
            found, _ = _judge(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v) for v in found.values())], ["doc_id", *found]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean"
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows with all their columns; ``text`` (and ``n_chars``, if there) without the removed lines."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in text_blocks(batches):
            found, stay = _judge(texts)
            text = pa.array([t.decode() for t in stay], pa.string())
            for name, column in (("text", text), ("n_chars", pc.utf8_length(text))):
                at = batch.schema.get_field_index(name)
                if at >= 0:
                    batch = batch.set_column(at, batch.schema.field(at), column.cast(batch.schema.field(at).type))
            yield batch.filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
