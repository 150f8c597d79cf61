"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound as the
product of its letters' vectors, rotated by their place; a text is the bundle
(sum) of its n-grams' vectors. Prototypes bundle the texts of a language, every
text with weight one, and a text gets the language whose prototype has the largest
cosine with its bundle. Letters are lower-cased; what is not a letter is a gap,
a run of gaps is one, and a text begins and ends with one.

Letter codes are code points modulo 255, so the tables stay at 256 rows for any
script (letters of one script keep codes of their own). The prototypes come from all learning
texts: every task adds up its texts per language, and one vector per language and
task is shuffled. The prototypes, one vector for each language, go to all tasks.

Row cases: text that is null or without a letter is ``und`` with score 0, as is
every text when nothing was learned. Null ``lang`` and texts without letters are not
learned from. Ties go to the first language in order. Every row is judged alone;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, text_blocks

WIDTH = 512
GRAM = 3
UNKNOWN = "und"
STEP = 4096
SHARED = 1 << 15
MOST_LANGUAGES = 10_000


def _letter_codes() -> np.ndarray:
    codes = np.zeros(0x10000, np.uint8)
    for point in range(0x10000):
        if chr(point).isalpha():
            codes[point] = 1 + point % 255
    return codes


class Space:
    """The random letter vectors, rotated for each place in an n-gram."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM):
        letters = np.random.Generator(np.random.PCG64(6)).integers(0, 2, (256, width)).astype(np.int8) * 2 - 1
        self.gram, self.width = gram, width
        self.placed = [np.roll(letters, gram - 1 - k, axis=1) for k in range(gram)]
        self.codes = _letter_codes()

    def grams(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The text's distinct n-grams, as numbers, and their counts; none without a letter."""
        points = np.frombuffer(text.decode().lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[np.minimum(points, 0xFFFF)].astype(np.int64)
        for at in np.flatnonzero(points > 0xFFFF):
            codes[at] = 1 + int(points[at]) % 255 if chr(points[at]).isalpha() else 0
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]
        if not codes.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(codes) < self.gram:
            codes = np.concatenate([codes, np.zeros(self.gram - len(codes), np.int64)])
        number = codes[: len(codes) - self.gram + 1].copy()
        for k in range(1, self.gram):
            number = number * 256 + codes[k : len(codes) - self.gram + 1 + k]
        return np.unique(number, return_counts=True)

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the n-grams' vectors."""
        out = np.zeros(self.width)
        for at in range(0, len(grams), STEP):
            out += weights[at : at + STEP].astype(np.float32) @ self._vectors(grams[at : at + STEP])
        return out

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        """Per text its number of distinct n-grams and its bundle; shared n-grams are bound once."""
        grams = np.unique(np.concatenate([t[0] for t in texts])) if texts else np.empty(0, np.int64)
        table = self._vectors(grams) if len(grams) <= SHARED else None
        for own, counts in texts:
            if table is None or len(own) > STEP:
                yield len(own), self.bundle(own, counts)
            else:
                yield len(own), counts.astype(np.float32) @ table[np.searchsorted(grams, own)]

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        bound = self.placed[-1][grams & 255]
        for k in range(self.gram - 1):
            bound = bound * self.placed[k][(grams >> (8 * (self.gram - 1 - k))) & 255]
        return bound.astype(np.float32)


def prototypes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Language to prototype, from all rows with ``lang`` and a letter in ``text``."""
    small_batches(docs.sparkSession)

    def run(batches):
        space, held = Space(width, gram), {}
        for batch, texts in text_blocks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                grams, counts = space.grams(text)
                if len(grams):
                    held.setdefault(lang, []).append((grams, counts / counts.sum()))
            for lang, parts in held.items():
                if len(parts) > 1:
                    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    held[lang] = [(grams, np.bincount(where, np.concatenate([p[1] for p in parts])))]
        rows = [(lang, space.bundle(*parts[0]).tolist()) for lang, parts in held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
            ["lang", "bundle"],
        )

    parts = docs.filter("lang is not null").select("lang", "text").mapInArrow(run, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(
        F.sum(F.round("x", 6).cast("decimal(28,6)")).cast("double").alias("x")  # exact, so reruns agree
    ).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("bundle"))
    found = {r.lang: np.array([x.x for x in r.bundle]) for r in summed.limit(MOST_LANGUAGES + 1).collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: lang does not name languages")
    return dict(sorted((k, v) for k, v in found.items() if np.any(v)))


def predict(docs: DataFrame, known: dict[str, np.ndarray], width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    small_batches(docs.sparkSession)
    names = list(known)
    profiles = np.array([known[k] / np.linalg.norm(known[k]) for k in names]) if names else np.empty((0, width))

    def best(space: Space, texts: list[bytes]) -> Iterator[tuple[str, float]]:
        for counts, bundle in space.bundles([space.grams(t) for t in texts]):
            if not counts or not names:
                yield UNKNOWN, 0.0
                continue
            cosines = profiles @ bundle / max(np.linalg.norm(bundle), 1e-12)
            at = int(np.argmax(cosines))
            yield names[at], float(min(1.0, max(0.0, cosines[at])))

    def run(batches):
        space = Space(width, gram)
        for batch, texts in text_blocks(batches):
            found = list(best(space, texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def _held_out():
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.pmod(number, F.lit(4)) == 2


def identify(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Learn from the rows that are not held out, then predict all rows."""
    return predict(docs, prototypes(docs.filter(~_held_out()), width, gram), width, gram)
