"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside {space, tab..CR}, or, if asked, outside ASCII punctuation too.  UTF-8 continuation bytes are all >= 0x80, so
scanning bytes gives the same words as scanning code points, and a whole column is hashed without making
a Python string per word.  A hash is a tabulated polynomial over the word's bytes modulo 2**64, with A-Z
folded to a-z, finished by a mixer; 64 bits keep the chance of any collision in a document below 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Also cuts at ASCII punctuation, for matches that should not depend on it.
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | _U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
        if size > 2 * CHUNK_BYTES:  # a giant text: do not hold its table for the life of the worker
            _powers.pop(base)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of some texts: hashes, byte spans (in data) and the first word of each text (texts + 1 entries)."""

    __slots__ = ("data", "offsets", "hashes", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, punctuation: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        if not n:
            self.hashes = np.zeros(0, np.uint64)
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        inside = ~(_PUNCTUATION if punctuation else _SEPARATOR)[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[data] * _power(_BASE, n)[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n)[self.starts])
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words of each text (fewer words: one of the whole), and where each text's begin."""
        count = np.diff(self.first)
        sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        if not begin[-1]:
            return np.zeros(0, np.uint64), begin
        at = np.arange(begin[-1]) + np.repeat(self.first[:-1] - begin[:-1], sizes)
        short = np.repeat(np.where(count < k, count, k), sizes)
        out = short.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        last = len(self.hashes) - 1
        whole = bool((short == k).all())
        for j in range(k):
            part = self.hashes[np.minimum(at + j, last)] * _WEIGHTS[j]
            out += part if whole else np.where(short > j, part, _U(0))
        return mix(out), begin

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all k consecutive words, whatever text they are of; those of shingles()."""
        n = max(len(self.hashes) - k + 1, 0)
        out = np.full(n, k, np.uint64) * _U(0xD6E8FEB86659FD93)
        for j in range(k if n else 0):
            out += self.hashes[j : n + j] * _WEIGHTS[j]
        return mix(out)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, punctuation: bool = False) -> Iterator[tuple[int, int, Words]]:
    """The column's words in runs of whole texts of about CHUNK_BYTES: (first row, end row, words)."""
    data, offsets = flat(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, n)
        yield at, end, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], punctuation)
        at = end
