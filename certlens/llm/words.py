"""Words and word hashes of whole Arrow string batches with numpy.

A word class is a set of byte values (all bytes from 0x80 on belong to one code
point or another, so classes over ASCII and "everything else" are exact on
UTF-8). Upper-case A-Z hash like a-z. A word's hash is a 64-bit polynomial over
random per-byte values, finished with a mixer; hashes are equal on every
executor. Work goes in segments of ``SEGMENT`` bytes, cut between words, so
memory follows the segment and the number of words, not the text length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
ROW_CHUNK = 4 << 20
#: Bytes that are worked on at once: numpy's arrays take some 50 times as much.
SCAN_CHUNK = 1 << 18

U = np.uint64
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def white_space_class() -> np.ndarray:
    """Words are ``[^\\x20\\x09-\\x0D]+``."""
    is_word = np.ones(256, dtype=bool)
    is_word[[32, 9, 10, 11, 12, 13]] = False
    return is_word


def alphanumeric_class() -> np.ndarray:
    """Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    is_word = np.zeros(256, dtype=bool)
    is_word[48:58] = is_word[97:123] = is_word[65:91] = is_word[128:] = True
    return is_word


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (two multiply-xorshift rounds)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and next(iter(_POWERS)) >= n:
        return next(iter(_POWERS.values()))
    size = max(n, SEGMENT)
    up = np.full(size, _BASE, dtype=np.uint64)
    up[0] = 1
    down = np.full(size, U(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
    down[0] = 1
    _POWERS.clear()
    _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = SCAN_CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row, if it is longer)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def scan(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, spans: bool = False):
    """(hashes, first): word hashes of all rows in order, and per row the index
    of its first word (with one more entry for the end). With ``spans`` also the
    words' start and end bytes."""
    mark = np.zeros(len(data) + 1, dtype=bool)
    mark[offsets] = True
    hashes, starts, ends = [], [], []
    at, total = 0, len(data)
    while at < total:
        to = min(at + SEGMENT, total)
        if to < total:
            gap = np.flatnonzero(~is_word[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # one word longer than a segment: go on to its end
                while to < total and is_word[data[to]]:
                    to += 1
        piece = data[at:to]
        inside = is_word[piece]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | mark[at:to]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        e = np.flatnonzero(inside & (~after | mark[at + 1 : to + 1])) + 1
        up, down = _powers(len(piece) + 1)
        total_hash = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=total_hash[1:])
        hashes.append(mix((total_hash[e] - total_hash[s]) * down[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(s, offsets, "left")
    if spans:
        return h, first, s, (np.concatenate(ends) if ends else s)
    return h, first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words (the caller drops those that cross rows)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, U(n * 0xA0761D6478BD642F & (1 << 64) - 1), dtype=np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * U(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64) | 1)
    return mix(out)
