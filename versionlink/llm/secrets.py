"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns (kinds ``assign``, ``access``, ``hex``) find the base spans of every whole
text. The field tags the words of a text as begin, inside or outside of a secret
(kind ``tagged``) from features of the word's shape, of the words before and after it, and
of the file; decoding is exact Viterbi. Tagged spans that touch no base span are added.

The field is trained here, by gradient ascent on the penalised likelihood of
windows labelled by the base spans. A pass over all texts makes the windows, per text at
most ``PER_TEXT`` around base spans and as many around other unusual words, those with the
least hash of id and place, and one at its middle;
the ``WINDOWS`` with spans and as many without, in the order of a hash of id and
place, are the bounded sample it is fitted on. Windows with an unlabelled word that
looks like a secret are left out, for it may be one.

Most words are ordinary: no digit, short, nothing near. When their score for outside
leads by more than any transitions can make up, the best path is outside there, so the
chain falls into short pieces that are decoded alone, with the same result. If the
trained scores do not allow that, the whole chain is decoded.

Row cases: null or blank text has no spans. Every row is judged alone; equal rows get
equal spans. Without any base span nothing is tagged. An empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, text_blocks
from versionlink.llm.hashing import Words

KINDS = ("assign", "access", "hex", "tagged")
LEAST = {"assign": 12, "access": 18, "hex": 16, "tagged": 8}
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
STARTS = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghs_", b"sk-", b"xox", b"eyJ", b"AIza", b"-----BEGIN")
WINDOWS = 2_000
AROUND = 10
PER_TEXT = 3
ROUNDS = 150
PENALTY = 1e-3
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"
_ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of the pattern matches, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Bits a byte gives its word.
_DIGIT, _LOWER, _UPPER, _EQUALS, _COLON, _QUOTE, _JOINT, _OTHER, _NOT_HEX = (1 << k for k in range(9))
_BITS = np.full(256, _OTHER | _NOT_HEX, np.uint16)
_BITS[list(b"0123456789")] = _DIGIT
_BITS[list(b"abcdef")] = _LOWER
_BITS[list(b"ghijklmnopqrstuvwxyz")] = _LOWER | _NOT_HEX
_BITS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER | _NOT_HEX
_BITS[ord("=")], _BITS[ord(":")] = _EQUALS | _NOT_HEX, _COLON | _NOT_HEX
_BITS[list(b"\"'`")] = _QUOTE
_BITS[list(b"_-/+.")] = _JOINT | _NOT_HEX
_BITS[list(b" \t\n\v\f\r")] = 0

FEATURES = (
    "bias", "to 3", "to 7", "to 15", "to 23", "to 39", "longer", "digit", "lower", "upper", "digit and both cases",
    "hexadecimal", "digits and joints", "quoted", "equals", "colon at end", "joint", "other", "varied", "known start", "key",
    "after key", "after assignment", "two after key", "before assignment", "file has keys", "file has digits",
)
_F = {name: k for k, name in enumerate(FEATURES)}
_PLACE = {name: np.int64(1) << np.int64(k) for name, k in _F.items()}
_NEAR = sum(_PLACE[n] for n in ("key", "after key", "after assignment", "two after key", "before assignment",
                                "varied", "known start", "hexadecimal", "digit", "equals", "longer", "to 39", "to 23"))
_ALIKE = sum(_PLACE[n] for n in ("varied", "known start"))


def _masks(words: Words, texts: list[bytes]) -> np.ndarray:
    """The features of every word of a block as bits of a number."""
    n = len(words.starts)
    if not n:
        return np.empty(0, np.int64)
    bits = np.bitwise_or.reduceat(_BITS[words.data], words.starts).astype(np.int64)
    size = words.ends - words.starts
    out = np.full(n, _PLACE["bias"])

    def put(name: str, where: np.ndarray) -> None:
        out[where] |= _PLACE[name]

    for name, low, high in (("to 3", 0, 3), ("to 7", 4, 7), ("to 15", 8, 15), ("to 23", 16, 23), ("to 39", 24, 39)):
        put(name, (size >= low) & (size <= high))
    put("longer", size > 39)
    digit = bits & _DIGIT > 0
    for name, bit in (("digit", _DIGIT), ("lower", _LOWER), ("upper", _UPPER), ("quoted", _QUOTE), ("equals", _EQUALS),
                      ("joint", _JOINT), ("other", _OTHER)):
        put(name, bits & bit > 0)
    put("digit and both cases", digit & (bits & _LOWER > 0) & (bits & _UPPER > 0))
    put("hexadecimal", (bits & _NOT_HEX == 0) & (size >= 12))
    put("digits and joints", digit & (bits & _JOINT > 0) & (bits & (_LOWER | _UPPER) == 0))
    last = words.data[words.ends - 1]
    colon = (last == ord(":")) & ~digit
    put("colon at end", colon)
    for k in np.flatnonzero((size >= 12) & (digit | (bits & (_UPPER | _JOINT) > 0))):
        word = words.word(k)
        if len(set(word)) >= 10 and digit[k]:
            out[k] |= _PLACE["varied"]
        if word.lstrip(b"\"'`").startswith(STARTS):
            out[k] |= _PLACE["known start"]
    key = np.zeros(n, bool)
    for k, text in enumerate(texts):
        low = text.lower()
        has = [word.encode() for word in KEYS if word.encode() in low]
        if has:
            own = words.of(k)
            out[own] |= _PLACE["file has keys"]
            for m in re.finditer(b"|".join(has), low):  # lower() keeps byte places in bytes
                key[np.searchsorted(words.starts, words.text_starts[k] + m.start(), "right") - 1] = True
    put("key", key)
    assign = colon | (last == ord("="))
    of = np.repeat(np.arange(len(words.counts)), words.counts)

    def shifted(mark: np.ndarray, by: int) -> np.ndarray:
        """``mark`` of the word ``by`` places before (after, if negative) in the same text."""
        moved = np.zeros(n, bool)
        if by > 0:
            moved[by:] = mark[:-by] & (of[by:] == of[:-by])
        else:
            moved[:by] = mark[-by:] & (of[:by] == of[-by:])
        return moved

    put("after key", shifted(key, 1))
    put("two after key", shifted(key, 2))
    put("after assignment", shifted(assign, 1))
    put("before assignment", shifted(assign & (size == 1), -1))
    share = np.bincount(of[digit], minlength=len(words.counts)) * 50 > words.counts
    put("file has digits", share[of])
    return out


def _matrix(masks: np.ndarray) -> np.ndarray:
    return ((masks[..., None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


class Field(NamedTuple):
    """Weights: features by tags, tags by next tags, first tags."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def scores(self, masks: np.ndarray) -> np.ndarray:
        return _matrix(masks) @ self.emit

    def decode(self, masks: np.ndarray, opened: bool) -> np.ndarray:
        """Viterbi: the best tags of one piece; ``opened`` if it begins its text, else it follows an outside word."""
        scores = self.scores(masks)
        best = scores[0] + (self.first if opened else self.step[OUTSIDE])
        back = np.zeros((len(masks), 3), np.int64)
        for t in range(1, len(masks)):
            ways = best[:, None] + self.step
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[t]
        tags = np.zeros(len(masks), np.int64)
        tags[-1] = int(best.argmax())
        for t in range(len(masks) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(windows: list[tuple[list[int], list[int]]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Field:
    """The field of most penalised likelihood for (features, tags) windows, by gradient steps from zero."""
    most, n = max(len(m) for m, _ in windows), len(windows)
    masks, tags, there = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for k, (m, t) in enumerate(windows):
        masks[k, : len(m)], tags[k, : len(m)], there[k, : len(m)] = m, t, True
    x = _matrix(masks) * there[..., None]
    gold = np.eye(3)[tags] * there[..., None]
    both = there[:, 1:] & there[:, :-1]
    gold_step = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both)
    weights = [np.zeros((len(FEATURES), 3)), np.zeros((3, 3)), np.zeros(3)]
    speed, size = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, rounds + 1):
        emit, step, first = weights
        scores = x @ emit
        ahead, behind = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        ahead[:, 0] = scores[:, 0] + first
        for t in range(1, most):
            new = _log_sum(ahead[:, t - 1, :, None] + step, 1) + scores[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = _log_sum(step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        total = _log_sum(ahead[:, -1], 1)
        own = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        pair = np.exp(
            ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        pair = np.where(both[..., None, None], pair, 0.0)
        slopes = [
            np.einsum("ntf,nta->fa", x, gold - own) / n - penalty * emit,
            (gold_step - pair.sum(axis=(0, 1))) / n - penalty * step,
            (gold[:, 0] - own[:, 0]).sum(axis=0) / n - penalty * first,
        ]
        for w, g, v, s in zip(weights, slopes, speed, size):
            v *= 0.9
            v += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            w += 0.1 * (v / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
    return Field(*weights)


def _tags_of(words: Words, k: int, text: str, raw: bytes, spans) -> np.ndarray:
    """Begin and inside for the words that the base spans of text ``k`` touch."""
    tags = np.zeros(int(words.counts[k]), np.int64)
    own = words.of(k)
    starts, ends = words.starts[own] - words.text_starts[k], words.ends[own] - words.text_starts[k]
    plain = len(text) == len(raw)
    for _, start, end in spans:
        low, high = (start, end) if plain else (len(text[:start].encode()), len(text[:end].encode()))
        first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high))
        if not tags[first:last].any():
            tags[first] = BEGIN
            tags[first + 1 : last] = INSIDE
    return tags


def _key(doc_id: int | None, at: int, size: int) -> int:
    return zlib.crc32(f"{doc_id}:{at}:{size}".encode())


def _sampled(places: np.ndarray, doc_id: int | None, size: int) -> list[int]:
    """The ``PER_TEXT`` places with the least hash of id and place, in their order."""
    if len(places) <= PER_TEXT:
        return places.tolist()
    return sorted(sorted(places.tolist(), key=lambda at: (_key(doc_id, at, size), at))[:PER_TEXT])


def windows(docs: DataFrame) -> DataFrame:
    """``key, found, masks, tags``: windows around base spans, and around other words that are not ordinary."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in text_blocks(batches):
            words = Words(texts)
            masks = _masks(words, texts)
            out = []
            for k, (doc_id, raw) in enumerate(zip(batch.column(0).to_pylist(), texts)):
                own = masks[words.of(k)]
                text = raw.decode()
                spans = base_spans(text)
                tags = _tags_of(words, k, text, raw, spans)
                inside = _sampled(np.flatnonzero(tags == BEGIN), doc_id, len(raw))
                odd = _sampled(np.flatnonzero((own & _NEAR > 0) & (tags == OUTSIDE)), doc_id, len(raw))
                for at in [*inside, *odd, *([len(own) // 2] if len(own) else [])]:
                    low, high = max(0, at - AROUND), at + AROUND + 1
                    part = tags[low:high]
                    if ((own[low:high] & _ALIKE > 0) & (part == OUTSIDE)).any():
                        continue
                    key = _key(doc_id, at, len(raw))
                    out.append((key, bool(part.any()), own[low:high].tolist(), part.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_()),
                 pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                ["key", "found", "masks", "tags"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "key long, found boolean, masks array<long>, tags array<long>"
    )


def train(docs: DataFrame, most: int = WINDOWS) -> Field | None:
    """The field fitted on at most ``most`` windows with and ``most`` without a span; none without spans."""
    made = windows(docs)
    sample = made.filter("found").sort("key", "masks").limit(most).unionByName(
        made.filter("not found").sort("key", "masks").limit(most)
    ).collect()
    if not any(r.found for r in sample):
        return None
    return fit([(r.masks, r.tags) for r in sorted(sample, key=lambda r: (r.key, r.masks))])


def _pieces(field: Field, masks: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words that may be tagged; between them the best path is outside for certain."""
    kinds, of = np.unique(masks, return_inverse=True)
    scores = field.scores(kinds)
    swing = max(field.step.max(), field.first.max()) - min(field.step.min(), field.first.min())
    sure = (scores[:, OUTSIDE] - scores[:, [BEGIN, INSIDE]].max(axis=1) > 2 * swing)[of]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sure, [True]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _tagged(field: Field, words: Words, masks: np.ndarray, k: int, raw: bytes) -> list[tuple[int, int]]:
    """Byte spans that the field finds in text ``k``, without quotes and closing marks at their ends."""
    own = masks[words.of(k)]
    spans, first = [], int(words.first[k])
    for low, high in _pieces(field, own) if len(own) else []:
        tags = field.decode(own[low:high], low == 0)
        t = 0
        while t < len(tags):
            if tags[t] == OUTSIDE:
                t += 1
                continue
            end = t + 1
            while end < len(tags) and tags[end] == INSIDE:
                end += 1
            start = int(words.starts[first + low + t] - words.text_starts[k])
            stop = int(words.ends[first + low + end - 1] - words.text_starts[k])
            piece = raw[start:stop]
            start += len(piece) - len(piece.lstrip(b"\"'`(["))
            stop -= len(piece) - len(piece.rstrip(b"\"'`)],.;!?"))
            if stop - start >= LEAST["tagged"]:
                spans.append((start, stop))
            t = end
    return spans


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, n_tagged, base_sha256, spans``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in text_blocks(batches):
            words = Words(texts)
            masks = _masks(words, texts) if field is not None else None
            columns: list[list] = [[] for _ in range(6)]
            for k, raw in enumerate(texts):
                text = raw.decode()
                base = base_spans(text)
                spans = list(base)
                for low, high in _tagged(field, words, masks, k, raw) if field is not None else []:
                    start = len(raw[:low].decode())
                    end = start + len(raw[low:high].decode(errors="ignore"))
                    if not any(s < end and start < e for _, s, e in base):
                        spans.append(("tagged", start, end))
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                values = [sum(s[0] == kind for s in spans) for kind in KINDS]
                values += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)]
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]),
                 *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_tagged", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_tagged long, base_sha256 string, spans string"
    )


def find_secrets(docs: DataFrame, most: int = WINDOWS) -> DataFrame:
    """Train on a bounded sample of ``docs``, then scan all of them."""
    return scan(docs, train(docs, most))
