"""FM-index over a sequence of small integers: suffix order, Burrows-Wheeler
transform in a wavelet matrix with bit-vector ranks, and sampled positions.

All searches are vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with constant-time rank: packed words and a running count."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
        self.word = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.word[block] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Rank and access over symbols, one bit vector per bit of the symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        row = symbols
        for level in reversed(range(self.depth)):
            one = (row >> level) & 1 == 1
            self.levels.append((Bits(one), int(len(row) - one.sum())))
            row = np.concatenate([row[~one], row[one]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bits, zeros), level in zip(self.levels, reversed(range(self.depth))):
            ones = bits.rank(i)
            i = np.where((c >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` before position ``i``."""
        return self._down(c, i) - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its occurrences before ``i``."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.rank(i)
            c = c * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.start[c]


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the only 0."""
    rank = seq.astype(np.int64)
    n, step = len(seq), 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        """``seq`` ends in 0, which occurs nowhere else; symbols are below ``sigma``."""
        order = suffix_order(seq)
        bwt = seq[order - 1]
        self.n = len(seq)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.tree = WaveletMatrix(bwt.astype(np.int64), sigma)
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.position = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the rows of a 2-D array: for the patterns that
        occur, their index and row interval."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in reversed(range(patterns.shape[1])):
            c = patterns[which, column]
            lo, hi = self.less[c] + self.tree.rank(c, lo), self.less[c] + self.tree.rank(c, hi)
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        found = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            known = self.sampled.get(at)
            found[todo[known]] = self.position[self.sampled.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                c, before = self.tree.access_rank(at)
                at = self.less[c] + before
            steps += 1
        return found
