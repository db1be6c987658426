"""A set of byte offsets in the manner of a Roaring bitmap, with rank and select.

Offsets are split into chunks of 65,536. Each chunk that holds any is one container,
the smallest of three forms: a sorted array (two bytes an offset), a bitmap (8 kB), or
runs (four bytes each). Containers carry cumulative cardinalities, so the k-th offset is
found by a search over them and a select inside one container. Memory follows the
chunks, not the gaps between offsets.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
ARRAY_MOST = 4096


class ArrayContainer:
    """Sorted 16-bit offsets."""

    form = "array"

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)
        self.bytes = 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])

    def rank(self, at: int) -> int:
        return int(np.searchsorted(self.low, at, "left"))


class BitmapContainer:
    """One bit an offset, in 64-bit words with cumulative counts."""

    form = "bitmap"

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.up_to = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.bytes = CHUNK // 8

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.up_to, k, "right"))
        left = k - (int(self.up_to[word - 1]) if word else 0)
        bits = int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1

    def rank(self, at: int) -> int:
        word, bit = divmod(at, 64)
        before = int(self.up_to[word - 1]) if word else 0
        return before + (int(self.words[word]) & (1 << bit) - 1).bit_count()


class RunContainer:
    """Runs of consecutive offsets, with the number of offsets before each."""

    form = "run"

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.lengths = starts, lengths
        self.before = np.cumsum(lengths) - lengths
        self.bytes = 4 * len(starts)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run] + k - self.before[run])

    def rank(self, at: int) -> int:
        run = int(np.searchsorted(self.starts, at, "left")) - 1
        return 0 if run < 0 else int(self.before[run] + min(at - self.starts[run], self.lengths[run]))


def _container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    if 4 * (len(breaks) + 1) <= min(2 * len(low), CHUNK // 8):
        starts = np.concatenate([[0], breaks])
        return RunContainer(low[starts], np.diff(starts, append=len(low)))
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A sorted set of offsets; ``len()``, ``select(k)`` (the k-th, from 0) and
    ``rank(x)`` (how many are smaller than x)."""

    def __init__(self, keys: list[int], containers: list, counts: list[int]):
        self.keys, self.containers = np.array(keys, np.int64), containers
        self.up_to = np.cumsum(np.array(counts, np.int64))

    @classmethod
    def of(cls, offsets: np.ndarray) -> BoundarySet:
        """From sorted distinct offsets."""
        key = offsets >> 16
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(offsets)]]) if len(offsets) else np.zeros(1, np.int64)
        pieces = [offsets[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return cls([int(p[0] >> 16) for p in pieces], [_container(p & CHUNK - 1) for p in pieces], [len(p) for p in pieces])

    @classmethod
    def full(cls, end: int) -> BoundarySet:
        """All offsets from 0 to ``end``: one run a chunk."""
        keys = range((end >> 16) + 1)
        sizes = [min(CHUNK, end + 1 - (k << 16)) for k in keys]
        return cls(list(keys), [RunContainer(np.zeros(1, np.int64), np.array([n])) for n in sizes], sizes)

    def __len__(self) -> int:
        return int(self.up_to[-1]) if len(self.up_to) else 0

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.up_to, k, "right"))
        return (int(self.keys[i]) << 16) + self.containers[i].select(k - (int(self.up_to[i - 1]) if i else 0))

    def rank(self, at: int) -> int:
        i = int(np.searchsorted(self.keys, at >> 16, "left"))
        before = int(self.up_to[i - 1]) if i else 0
        if i == len(self.keys) or self.keys[i] != at >> 16:
            return before
        return before + self.containers[i].rank(at & CHUNK - 1)


def boundaries(data: np.ndarray, unit: str = "char") -> BoundarySet:
    """Where a UTF-8 text may be cut: its start, its end, and between its units,
    which are code points (``char``), words with the white space before them
    (``word``) or lines with their line end (``line``)."""
    n = len(data)
    if unit == "char":
        starts = data & 0xC0 != 0x80
        return BoundarySet.full(n) if starts.all() else BoundarySet.of(np.append(np.flatnonzero(starts), n))
    if unit == "word":
        white = (data == 32) | (data >= 9) & (data <= 13)
        inner = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    elif unit == "line":
        inner = np.flatnonzero(data == 10) + 1
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return BoundarySet.of(np.unique(np.concatenate([[0], inner, [n]])))
