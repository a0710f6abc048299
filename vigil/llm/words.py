"""Vectorised words, word hashes, n-grams and sliding minima over Arrow text.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All functions
work on a slice of whole documents at once; positions count from the slice's
first byte or word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# punctuation reads as space where texts are compared loosely
_LOOSE = _LOWER.copy()
_LOOSE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, kept for the next slice."""
    if len(_tables[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[k] = np.multiply.accumulate(t)
    return _tables[0][:n], _tables[1][:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(t.copy() for t in _powers(n))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray     # the slice's bytes
    start: np.ndarray    # first byte of every word
    end: np.ndarray      # byte after every word
    bounds: np.ndarray   # of document d: words bounds[d] to bounds[d + 1]
    hash: np.ndarray     # 64-bit hash of every word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def text(self, first: int, last: int) -> bytes:
        """Words first..last joined by one space."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in
                         zip(self.start[first:last + 1], self.end[first:last + 1], strict=True))

    def after(self, n: int) -> np.ndarray:
        """True where a run of n words starting here ends in the same document."""
        m = len(self.start)
        ok = np.zeros(m, bool)
        if m >= n:
            doc = self.doc
            ok[:m - n + 1] = doc[:m - n + 1] == doc[n - 1:]
        return ok

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position; the last n - 1 are absent."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = self.hash[:m].copy()
        for j in range(1, n):
            h *= _GRAM
            h += self.hash[j:j + m]
        return mix(h)


def words_of(texts: pa.Array, lower: bool = False, loose: bool = False) -> Words:
    """The words of a string array; nulls count as empty texts. ``lower``
    lower-cases A-Z; ``loose`` also reads ASCII punctuation as space."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    _, off_buf, data_buf = texts.buffers()
    if n == 0 or data_buf is None:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(n + 1, np.int64),
                     np.zeros(0, np.uint64))
    off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1]
    off = off.astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    if lower or loose:
        data = (_LOOSE if loose else _LOWER)[data]
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(n + 1, np.int64), np.zeros(0, np.uint64))
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = off[(off > 0) & (off < size)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    # a word's hash sums a scrambled number for each byte and its place in the word
    place = np.arange(size) - start[np.maximum(np.cumsum(first) - 1, 0)] if len(start) else np.zeros(size, np.int64)
    place <<= 8
    place |= data
    summed = np.zeros(size + 1, np.uint64)
    np.cumsum(mix(place.view(np.uint64) * np.uint64(_BASE)), out=summed[1:])
    h = summed[end] - summed[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return Words(data, start, end, np.searchsorted(start, off), mix(h))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out
