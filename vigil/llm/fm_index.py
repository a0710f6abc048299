"""Compressed FM-index over integer symbols: Burrows-Wheeler transform in a
wavelet matrix of bit-packed levels, searched backwards for many patterns at
once."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols: prefix doubling
    from ranks of as many symbols as one 64-bit key holds, re-sorting only
    suffixes that are still equal to another."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length() + 1)
    have = max(1, 62 // bits)
    key = np.zeros(n + have, np.int64)
    for k in range(min(have, n)):
        key[:n - k] |= (s[k:].astype(np.int64) + 1) << (bits * (have - 1 - k))
    key = key[:n]
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: the group's first place
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = np.flatnonzero(~new | np.append(~new[1:], False))       # places in groups of two or more
    while have < depth and len(tied):
        at = order[tied]
        later = at + have
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        order[tied] = at[by]
        key = key[by]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[order[tied]] = tied[first]
        tied = tied[~new | np.append(~new[1:], False)]
        have *= 2
    return order


class _Bits:
    """A bit vector with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int32)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class FMIndex:
    def __init__(self, s: np.ndarray, depth: int):
        """``s``: symbols from 0; searches of up to ``depth`` symbols are exact."""
        n = len(s)
        order = suffix_array(s, depth)
        bwt = s[order - 1].astype(np.int64)  # the symbol before each suffix, cyclic
        self.sigma = int(s.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=self.sigma))])
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(bit), int(n - bit.sum())))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after putting ``symbol`` in front of what lo..hi match."""
        a, b, zero = lo, hi, np.zeros_like(lo)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            ra, rb, rz = bits.ones(a), bits.ones(b), bits.ones(zero)
            a = np.where(one, zeros + ra, a - ra)
            b = np.where(one, zeros + rb, b - rb)
            zero = np.where(one, zeros + rz, zero - rz)
        return self.first[symbol] + a - zero, self.first[symbol] + b - zero

    def statistics(self, s: np.ndarray, last: np.ndarray, limit: int) -> np.ndarray:
        """Matching statistics of a streamed text: for each position in
        ``last`` the length, up to ``limit``, of the longest run of symbols of
        ``s`` that ends there and occurs at least twice in the index."""
        out = np.zeros(len(last), np.int64)
        live = np.arange(len(last))
        lo = np.zeros(len(last), np.int64)
        hi = np.full(len(last), self.first[-1], np.int64)
        for k in range(limit):
            at = last[live] - k
            inside = at >= 0
            live, at, lo, hi = live[inside], at[inside], lo[inside], hi[inside]
            if not len(live):
                break
            lo, hi = self.extend(s[at], lo, hi)
            twice = hi - lo >= 2
            live, lo, hi = live[twice], lo[twice], hi[twice]
            out[live] = k + 1
        return out
