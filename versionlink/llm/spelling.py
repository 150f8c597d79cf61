"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

Words are counted over all texts (partial counts per task). A word of at least
``LENGTH`` code points that occurs ``TIMES`` times or more is looked for among all others.

Search scheme: a word is cut in two halves. If one edit parts two words, one half is
untouched: either the left half matches exactly and the search extends to the right
with one error, or the right half matches exactly and the search extends to the left with one
error. Both run on a :class:`BidirectionalIndex` of the delimited words, whose states
are intervals of suffix ranks, kept for the text and its reverse together; a state steps
to all letters at once, so errors only follow letters that occur there. A whole word lies
between two delimiters; what both searches find is counted by the first alone.

Distribution: the untouched half brings the words together. A word of ``m`` code points is
indexed under ``m`` and its first, and its last, ``(m - 1) // 2`` code points; a word
that searches goes to the same keys for each length one edit reaches. Keys are hashed
into buckets of some ``PIECE`` words with an index each; a key of more words is cut
into several pieces, and searching words go to each, so a common beginning takes no
task beyond that size. A bucket sends one row a word on: how many it found and the
most frequent.

Row cases: null and empty texts hold no words, equal rows count each, null ids are
written as ``null`` where the id decides on a letter. Ties go to the smaller word in code
point order. Without rows there is no result. A word of any length is one pattern, read
letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlink.llm.common import small_batches, stored, text_blocks
from versionlink.llm.tokens import Runs

LENGTH = 7
TIMES = 2
RATIO = 10
ONE_IN = 31
PIECE = 5_000
STATES = 2_048
DISTINCT = 100_000
STEP = 16
END = 0  # the delimiter's symbol

# Per place in a block of ``STEP`` symbols, those before it.
INSIDE = np.arange(STEP) < np.arange(STEP)[:, None]
_LETTER = np.array([0x61 <= b <= 0x7A for b in range(256)])


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of a to z and of U+00C0 to U+00FF (0xC3 and the byte after it)."""
    lead = data == 0xC3
    return _LETTER[data] | lead | np.concatenate([[False], lead[:-1]])


def _altered(ids: list, runs: Runs, one_in: int) -> Iterator[tuple[bytes, int]]:
    """The words of a block with their counts; one run in ``one_in`` loses a letter, by the hash of id and run.

    The checksum of ``<id>:<run>`` is the run's own checksum moved by what the prefix does
    to any run of that length, so it is taken once a distinct run, and once a length for each text.
    """
    own = np.array([zlib.crc32(w) for w in runs.distinct], np.int64)
    size = np.array([len(w) for w in runs.distinct], np.int64)
    points = np.array([len(w.decode()) for w in runs.distinct], np.int64)
    code = runs.code
    if not len(code):
        return
    shift = np.empty(len(code), np.int64)
    for key, first, end in zip(ids, runs.first[:-1], runs.first[1:]):
        prefix = zlib.crc32(f"{'null' if key is None else key}:".encode())
        lengths, at = np.unique(size[code[first:end]], return_inverse=True)
        moved = [zlib.crc32(bytes(n), prefix) ^ zlib.crc32(bytes(n)) for n in lengths.tolist()]
        shift[first:end] = np.array(moved, np.int64)[at] if moved else 0
    hashed = own[code] ^ shift
    hit = hashed % one_in == 0
    counts = np.bincount(code[~hit], minlength=len(own))
    for k in np.flatnonzero(counts):
        if points[k] >= LENGTH:
            yield runs.distinct[k], int(counts[k])
    for k, h in zip(code[hit].tolist(), hashed[hit].tolist()):
        if points[k] > LENGTH:
            word = runs.distinct[k].decode()
            at = h % len(word)
            yield (word[:at] + word[at + 1 :]).encode(), 1


def vocabulary(docs: DataFrame, times: int = TIMES, one_in: int = ONE_IN) -> DataFrame:
    """``word, n``: words of ``LENGTH`` code points or more that occur ``times`` times or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch, block in text_blocks(batches):
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            for word, n in _altered(ids, Runs(block, _letters), one_in):
                total[word] += n
            if len(total) >= DISTINCT:
                yield out()
                total.clear()
        yield out()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= times)


class _Side:
    """Occurrence counts of one direction: how often each symbol stands before a suffix rank."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        while True:  # order of all rotations by doubling; distinct words make them distinct
            pair = rank * (n + symbols) + np.roll(rank, -reach)
            order = np.argsort(pair, kind="stable")
            ranked = pair[order]
            fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            reach *= 2
        self.order, self.symbols = order, symbols
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=symbols))])[:-1]
        blocks = n // STEP + 1
        padded = np.full(blocks * STEP, symbols, np.uint8)  # letters of words are under 256
        padded[:n] = last
        self.blocks = padded.reshape(blocks, STEP)
        held = np.bincount(np.arange(n) // STEP * symbols + last, minlength=blocks * symbols).reshape(blocks, symbols)
        self.held = (np.cumsum(held, axis=0) - held).astype(np.int32)
        self.less = np.cumsum(self.held, axis=1, dtype=np.int32) - self.held

    def before(self, rank: np.ndarray) -> np.ndarray:
        """Per rank and symbol, how often the symbol stands before it."""
        block, inside = rank // STEP, rank % STEP
        row, place = np.nonzero(INSIDE[inside])
        counted = np.bincount(row * self.symbols + self.blocks[block[row], place], minlength=len(rank) * self.symbols)
        return self.held[block] + counted.reshape(len(rank), self.symbols)

    def of(self, rank: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each rank's own symbol, and the symbols smaller than it, stand before the rank."""
        block = rank // STEP
        near, inside, own = self.blocks[block], INSIDE[rank % STEP], symbol[:, None]
        count = lambda hit: np.bitwise_count((hit & inside).view(np.uint64)).sum(axis=1, dtype=np.int64)
        return self.held[block, symbol] + count(near == own), self.less[block, symbol] + count(near < own)


class BidirectionalIndex:
    """FM-index of delimited distinct words and of their reverse, over the rotations of one cyclic text."""

    def __init__(self, words: list[str]):
        letters = sorted({c for w in words for c in w})
        self.symbol = {c: k + 1 for k, c in enumerate(letters)}
        self.symbols = len(letters) + 1
        joined = np.array([s for w in words for s in (END, *(self.symbol[c] for c in w))], np.int64)
        self.size = len(joined)
        self.starts = np.flatnonzero(joined == END)
        self.sides = {False: _Side(joined, self.symbols), True: _Side(joined[::-1].copy(), self.symbols)}

    def steps(self, low: np.ndarray, mirror: np.ndarray, count: np.ndarray, right: bool) -> tuple[np.ndarray, ...]:
        """The states after each symbol: ``low``, ``mirror`` and ``count``, a column a symbol.

        ``low`` and ``mirror`` are the interval's first ranks in the text and in its reverse.
        """
        side = self.sides[right]
        own, other = (mirror, low) if right else (low, mirror)
        start = side.before(own)
        sizes = side.before(own + count) - start
        other = other[:, None] + np.cumsum(sizes, axis=1) - sizes
        own = side.first + start
        return (other, own, sizes) if right else (own, other, sizes)

    def step(self, low: np.ndarray, mirror: np.ndarray, count: np.ndarray, symbol: np.ndarray, right: bool) -> tuple[np.ndarray, ...]:
        """The states after each state's own symbol."""
        side = self.sides[right]
        own, other = (mirror, low) if right else (low, mirror)
        start, less = side.of(own, symbol)
        end, less_end = side.of(own + count, symbol)
        other, own, size = other + less_end - less, side.first[symbol] + start, end - start
        return (other, own, size) if right else (own, other, size)

    def word_at(self, low: np.ndarray) -> np.ndarray:
        """Which word begins after the delimiter at these ranks."""
        return np.searchsorted(self.starts, self.sides[False].order[low])


def near_words(index: BidirectionalIndex, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, indexed word) with exactly one edit behind the exact half.

    With ``right`` the left half is exact and the search extends to the right; else the
    right half is exact and it extends to the left. Pairs come once.
    """
    found = [_near(index, queries[at : at + STATES], right) for at in range(0, len(queries), STATES)]
    pairs = [np.stack([q + k * STATES, w]) for k, (q, w) in enumerate(found)]
    return tuple(np.concatenate(pairs, axis=1)) if pairs else (np.zeros(0, np.int64),) * 2


def _near(index: BidirectionalIndex, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    order = queries if right else [w[::-1] for w in queries]
    length = np.array([len(w) for w in order], np.int64)
    exact = length // 2 if right else length - length // 2
    start = np.cumsum(length + 1) - length - 1
    # one more place a query, for the closing delimiter; -1: a letter the index does not hold
    letters = np.array([s for w in order for s in (*(index.symbol.get(c, -1) for c in w), END)], np.int64)

    def match(state: tuple, symbol: np.ndarray) -> tuple:
        """States (query, place, low, mirror, count) that go on with their own symbol."""
        held = symbol >= 0
        query, place, *interval = pick(state, held)
        low, mirror, count = index.step(*interval, symbol[held], right)
        return pick((query, place + 1, low, mirror, count), count > 0)

    pick = lambda state, which: tuple(a[which] for a in state)
    own = lambda state: letters[start[state[0]] + state[1]]
    halves = [w[:k] for w, k in zip(order, exact.tolist())]
    of_half: dict[str, int] = {}
    first = [q for q, h in enumerate(halves) if of_half.setdefault(h, q) == q]  # a half is matched once
    n = len(first)
    state = (np.array(first, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.size))
    state = match(state, np.full(n, END))
    waiting, ready = state, []
    while len(waiting[0]):  # the exact half
        done = waiting[1] == exact[waiting[0]]
        ready.append(pick(waiting, done))
        waiting = pick(waiting, ~done)
        if len(waiting[0]):
            waiting = match(waiting, own(waiting))
    open_states = tuple(np.concatenate(a) for a in zip(*ready)) if ready else state
    row_of = np.full(len(queries), -1)
    row_of[open_states[0]] = np.arange(len(open_states[0]))
    rows = row_of[[of_half[h] for h in halves]] if halves else row_of
    open_states = (np.flatnonzero(rows >= 0), *(a[rows[rows >= 0]] for a in open_states[1:]))
    erred, pairs = [], []
    while len(open_states[0]):  # the other half, no error so far: each state sends off all single errors
        query, place, *_ = open_states
        low, mirror, count = index.steps(*open_states[2:], right)
        row, symbol = np.nonzero(count > 0)
        keep = symbol != END
        row, symbol = row[keep], symbol[keep]
        child = lambda r, s, move: (query[r], place[r] + move, low[r, s], mirror[r, s], count[r, s])
        inserted = child(row, symbol, 0)
        ended = place == length[query]
        other = ~ended[row] & (symbol != own(open_states)[row])
        replaced = child(row[other], symbol[other], 1)
        q, p, *interval = pick(open_states, ~ended)
        erred += [inserted, replaced, (q, p + 1, *interval)]
        goes_on = pick(open_states, ~ended)
        open_states = match(goes_on, own(goes_on)) if len(goes_on[0]) else goes_on
    after = tuple(np.concatenate(a) for a in zip(*erred)) if erred else state
    while len(after[0]):  # the rest exactly, up to the delimiter
        moved = []
        for at in range(0, len(after[0]), STATES):
            part = tuple(a[at : at + STATES] for a in after)
            moved.append(match(part, own(part)))
        after = tuple(np.concatenate(a) for a in zip(*moved))
        done = after[1] > length[after[0]]
        pairs.append(np.stack([after[0][done], index.word_at(after[2][done])]))
        after = pick(after, ~done)
    both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _search(bucket: pd.DataFrame) -> pd.DataFrame:
    """Per searching word of a bucket the number of near words in it, and the most frequent one."""
    out: dict[str, list] = {"word": [], "n_near": [], "form_n": [], "form": []}
    for right, rows in bucket.groupby("right"):
        held = rows[rows["n"].notna()].sort_values("word", ignore_index=True)
        words, counts = held["word"].tolist(), held["n"].to_numpy(np.int64)
        queries = sorted(set(rows.loc[rows["n"].isna(), "word"]))
        if not words or not queries:
            continue
        query, near = near_words(BidirectionalIndex(words), queries, bool(right))
        if not right:  # those that share the left half too were found from there
            half = [q[: len(q) // 2] for q in queries]
            fresh = np.array([not words[w].startswith(half[q]) for q, w in zip(query, near)], bool)
            query, near = query[fresh], near[fresh]
        order = np.lexsort([near, -counts[near], query])  # words are sorted, so places are in their order
        query, near = query[order], near[order]
        asked, first, found = np.unique(query, return_index=True, return_counts=True)
        out["word"] += [queries[q] for q in asked]
        out["n_near"] += found.tolist()
        out["form_n"] += counts[near[first]].tolist()
        out["form"] += [words[w] for w in near[first]]
    return pd.DataFrame(out).astype({"word": object, "form": object, "n_near": "int64", "form_n": "int64"})


def near_of(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """``word, n_near, best`` for every word of ``word, n`` that has near words; best is (-n, word)."""
    total = words.count()
    buckets = max(1, -(-2 * total // piece))
    half = lambda m: F.floor((m - 1) / 2).cast("int")
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("right")
    part = F.when(F.col("right"), F.left("word", half(F.col("m")))).otherwise(F.right("word", half(F.col("m"))))
    key = ["right", "m", "part"]
    held = words.select("word", "n", sides, F.length("word").alias("m")).withColumn("part", part)
    lengths = F.array(*[F.length("word") + d for d in (-1, 0, 1)])
    asks = words.select("word", sides, F.explode(lengths).alias("m")).filter(F.col("m") >= LENGTH).withColumn("part", part)
    large = held.groupBy(*key).agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).filter("pieces > 1")
    held = held.join(large, key, "left").withColumn(
        "at", F.coalesce(F.pmod(F.xxhash64(F.lit("piece"), "word"), F.col("pieces")).cast("int"), F.lit(0))
    )
    asks = asks.join(large, key, "left").withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1))
    ).withColumn("n", F.lit(None).cast("long"))
    bucket = F.pmod(F.xxhash64(*key, "at"), F.lit(buckets))
    rows = held.unionByName(asks).select(bucket.alias("bucket"), "word", "n", "right")
    found = rows.groupBy("bucket").applyInPandas(_search, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("fall"), "form")).alias("best")
    )


def variants(docs: DataFrame, times: int = TIMES, ratio: int = RATIO, one_in: int = ONE_IN, piece: int = PIECE) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the word's more frequent form, and the last of its forms."""
    words = stored(vocabulary(docs, times, one_in))
    near = near_of(words, piece)
    often = -F.col("best.fall") >= ratio * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.fall")).alias("form_n"),
    ))
    return rows.join(_roots(rows), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form; a form is many times as frequent, so chains are short and end."""
    jumps = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jumps.join(further, "root", "left_semi").isEmpty():
            return jumps
        jumps = stored(jumps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
