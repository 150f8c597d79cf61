"""Vectorised 64-bit hashes of words and of runs of words.

A run's hash is a polynomial sum modulo 2**64, taken as the difference of two
running sums and moved to power zero by the inverse of the (odd) base, so all
runs of a block cost a few array passes. A final mix spreads the bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CHUNK = 1 << 17
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(length + 1, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair of ascending bounds; equal runs get equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        high = int(ends[to - 1])
        size = 1 << max(12, int(high - low).bit_length())
        up, down = _powers(base, size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[low:high] * up[: high - low], dtype=np.uint64)])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


class Words:
    """The words of a block of texts: byte bounds, hashes, and each text's first word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        inside = ~SPACE[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return run_hashes(BYTE[self.data], self.starts, self.ends)

    def of(self, text: int) -> slice:
        return slice(int(self.first[text]), int(self.first[text + 1]))

    def windows(self, hashes: np.ndarray, length: int, base: int = BASES[1]) -> np.ndarray:
        """Hash of the ``length`` words from each word on; use ``of_windows`` for those inside one text."""
        starts = np.arange(max(0, len(hashes) - length + 1))
        return run_hashes(hashes, starts, starts + length, base)

    def of_windows(self, text: int, length: int) -> slice:
        first, end = int(self.first[text]), int(self.first[text + 1])
        return slice(first, max(first, end - length + 1))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()
