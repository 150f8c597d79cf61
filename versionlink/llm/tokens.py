"""Runs of wanted bytes in a block of texts, as numbers of a dictionary of distinct runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from versionlink.llm.hashing import LOWER


class Runs:
    """The maximal runs of a block of texts, lower-cased from A to Z.

    ``inside`` tells for an array of bytes which belong to runs; the line feed must not,
    as it parts the texts. ``code`` numbers each run by its place in ``distinct``, and
    ``first`` holds each text's first run. Equality is of bytes, not of hashes.
    """

    def __init__(self, texts: list[bytes], inside: Callable[[np.ndarray], np.ndarray]):
        data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        mask = inside(data)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[mask]))]
        ).dictionary_encode()
        self.code = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: list[bytes] = runs.dictionary.to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]))
        self.counts = np.diff(self.first)
