"""A compressed FM-index over sequences of integers, searched for many patterns at once.

The Burrows-Wheeler transform is of suffixes ordered by their first ``depth``
symbols, which is all that patterns of up to ``depth`` symbols need, and is kept
in a wavelet matrix of packed bits with a running count for each 64.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Rank queries over an integer sequence."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        start = np.zeros(symbols, np.int64)
        every = np.arange(symbols)
        for level in reversed(range(self.levels)):
            bit = (x >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bit.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(x) - bit.sum()))
            start = self._down(len(self.bits) - 1, start, (every >> level) & 1)
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.start = start

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        block = at >> 6
        inside = self.bits[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        ones = self.before[k][block] + np.bitwise_count(inside).astype(np.int64)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for k, level in enumerate(reversed(range(self.levels))):
            at = self._down(k, at, (symbol >> level) & 1)
        return at - self.start[symbol]


class FMIndex:
    """Index of a text of symbols from 1; 0 separates."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        n = len(text)
        symbols = int(text.max(initial=0)) + 1
        # Ranks of the prefixes of 1, 2, 4, ... symbols; then of exactly ``depth``.
        rank, size, ranks = text.astype(np.int64), 1, {1: text.astype(np.int64)}
        while size * 2 <= depth:
            rank = self._join(rank, rank, size)
            size *= 2
            ranks[size] = rank
        done = size
        while done < depth:
            size = 1 << ((depth - done).bit_length() - 1)
            rank = self._join(rank, ranks[size], done)
            done += size
        self.places = np.argsort(rank, kind="stable")
        ordered = rank[self.places]
        edge = np.append(True, ordered[1:] != ordered[:-1]) if n else np.zeros(0, bool)
        # First place of the suffixes that agree with each on ``depth`` symbols.
        self.group = np.maximum.accumulate(np.where(edge, np.arange(n), 0)).astype(np.int32)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = Wavelet(text[self.places - 1] if n else text, symbols)
        self.size = n

    @staticmethod
    def _join(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
        shifted = np.zeros(len(right), np.int64)
        shifted[: max(0, len(right) - by)] = right[by:]
        return np.unique(left * (right.max(initial=0) + 1) + shifted, return_inverse=True)[1]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of suffixes that start with each row of ``patterns`` (of one length, at most the depth)."""
        m = len(patterns)
        low, high = np.zeros(m, np.int64), np.full(m, self.size, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[:, j]
            both = self.count[np.concatenate([c, c])] + self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = both[:m], both[m:]
        return low, high

    def slide(self, low: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """From the intervals of patterns of full depth to those of the patterns one place to the left.

        One backward step prepends the symbol; going to the first suffix that
        agrees on ``depth`` symbols drops the last one.  The pattern has to
        occur in the text.
        """
        return self.group[self.count[symbol] + self.wavelet.rank(symbol, low)].astype(np.int64)

    def ends(self, low: np.ndarray) -> np.ndarray:
        """Where intervals of full depth that begin at ``low`` end."""
        starts = np.unique(self.group)
        return np.append(starts[1:], self.size)[np.searchsorted(starts, low)]
