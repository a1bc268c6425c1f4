"""Words and hashed word windows of many texts at once, in numpy.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text. The functions
here run inside Spark tasks on Arrow string columns; they hold one bounded block of texts
(``BLOCK`` bytes, or a single longer text) at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the one of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


class Words:
    """The words of one block: ``start``/``end`` byte offsets, ``doc`` index, ``hash``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: Powers) -> None:
        self.data, self.bounds = data, bounds
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.ones(len(data) + 1, bool)  # True where no word can run on from the left
        edge[1:-1] = space[:-1]
        edge[bounds] = True
        ends = edge.copy()
        ends[:-1] |= space
        self.start = np.flatnonzero(edge[:-1] & ~space)
        self.end = np.flatnonzero(ends[1:] & ~space) + 1
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        up, down = powers.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * up[: len(data)], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length * np.uint64(_STEP))
        self.count = np.bincount(self.doc, minlength=len(bounds) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # of each document, in words

    def windows(self, n: int, powers: Powers, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one document."""
        hashes = self.hash if of is None else of
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = powers.upto(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[:m]), self.doc[:m] == self.doc[n - 1 :]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def byte_powers() -> Powers:
    return Powers(_BASE | 1)


def word_powers() -> Powers:
    return Powers(_STEP | 1)


def blocks(texts: pa.Array | pa.ChunkedArray, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document bounds) of successive blocks; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
    spare()


def spare() -> None:
    """Give memory that is no longer used back to the system: an executor's Python workers share it with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim is not None:
        trim(0)
