"""A compressed FM-index over words, searched for many patterns at once.

The Burrows-Wheeler transform is held in a wavelet tree of bit vectors in level order (one vector per
bit of a symbol, zeros before ones), so that the rank of a symbol takes one look-up per bit.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - k)] = rank[k:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after if k > 1 else rank * (n + int(symbols.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else 0
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class BitVector:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, until: np.ndarray) -> np.ndarray:
        """Ones among the first ``until`` bits."""
        at = until >> 6
        low = (np.uint64(1) << (until & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    """``symbols`` are numbers from 0, the last one a symbol of its own; ``weights`` say how often each position counts."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray):
        self.size = len(symbols)
        order = suffix_array(symbols)
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        last = symbols[order - 1].astype(np.int64)
        n_symbols = int(symbols.max(initial=0)) + 1
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append(BitVector(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(n_symbols)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))[:-1]])
        # where a symbol's run begins at the lowest level is taken off once, here
        self.shift = smaller - self._descend(every, np.zeros(n_symbols, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, until: np.ndarray) -> np.ndarray:
        for vector, zeros, level in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            ones = vector.ones(until)
            until = np.where((symbol >> level) & 1 == 1, ones + zeros, until - ones)
        return until

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with one more symbol on the left."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[:len(symbol)] + self.shift[symbol], both[len(symbol):] + self.shift[symbol]

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[np.maximum(hi, lo)] - self.weight[lo]


def reach(index: FMIndex, text: np.ndarray, end: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Matching statistics by backward search: the least position, not below ``floor``, from which
    the text up to and including ``end`` occurs at least twice in the index (``end + 1`` if none)."""
    at = end.astype(np.int64).copy()
    lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), index.size, dtype=np.int64)
    live = np.arange(len(at))
    while len(live):
        lo_, hi_ = index.extend(text[at[live]], lo[live], hi[live])
        twice = index.occurrences(lo_, hi_) >= 2
        live, lo_, hi_ = live[twice], lo_[twice], hi_[twice]
        lo[live], hi[live] = lo_, hi_
        at[live] -= 1
        live = live[at[live] >= floor[live]]
    return at + 1


def _shortest_single(index: FMIndex, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least position up to which the text from ``start`` occurs once; up to ``end`` it does."""
    known, single = start - 1, end.copy()
    width = np.ones(len(start), dtype=np.int64)
    live = np.flatnonzero(known + 1 < single)
    while len(live):
        # gallop while everything has occurred twice, then halve
        probe = np.where(width[live] > 0, np.minimum(start[live] + width[live] - 1, single[live] - 1), (known[live] + single[live]) // 2)
        once = reach(index, text, probe, start[live]) > start[live]
        single[live[once]] = probe[once]
        width[live[once]] = 0
        known[live[~once]] = probe[~once]
        width[live[~once]] *= 2
        live = live[known[live] + 1 < single[live]]
    return single


def repeated_stretches(index: FMIndex, text: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, from, to): stretches of at least ``least`` words of patterns text[first..last] that occur twice."""
    which, end = np.arange(len(first)), last.astype(np.int64).copy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(which):
        a = reach(index, text, end, first[which])
        long = end - a + 1 >= least
        out.append((which[long], a[long], end[long] + 1))
        more = a > first[which]
        which, a, end = which[more], a[more], end[more]
        # no stretch that begins before a holds the shortest single one from a - 1
        end = _shortest_single(index, text, a - 1, end) - 1
        open_ = end - first[which] + 1 >= least
        which, end = which[open_], end[open_]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=np.int64) for k in range(3))
