"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one task (``SHARD`` bytes of text, or one
longer document). Its words become symbols of the benchmark's vocabulary; a word
that no test phrase holds ends a run, and runs shorter than the shortest phrase
are left out, which loses no occurrence. The shard's index is searched backward
for all test phrases at once; occurrences are located from sampled positions and
merged into removal spans.

The test phrases are a stated query set: they reach the executors in blocks of
``BLOCK_WORDS`` words, each broadcast on its own; every block is searched in
every shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm import words
from certlens.llm.fm_index import FMIndex
from certlens.llm.shared import free_name, keep, row_key, short_batches, side

WINDOW = 13
SHARD = 4 << 20
BLOCK_WORDS = 200_000


@dataclass
class Block:
    """Test phrases: the sorted word hashes, and per phrase length the distinct
    phrases as symbols and the items that hold each (``items[at[i]:at[i+1]]``)."""

    vocabulary: np.ndarray
    phrases: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _block(items: list[tuple[str, np.ndarray]], window: int) -> Block:
    vocabulary = np.unique(np.concatenate([h for _, h in items]))
    by_length: dict[int, dict[bytes, set[str]]] = {}
    for name, h in items:
        symbols = (np.searchsorted(vocabulary, h) + 2).astype(np.int64)
        size = min(window, len(symbols))
        own = by_length.setdefault(size, {})
        for i in range(len(symbols) - size + 1):
            own.setdefault(symbols[i : i + size].tobytes(), set()).add(name)
    phrases = []
    for size, found in sorted(by_length.items()):
        held = [sorted(x) for x in found.values()]
        phrases.append((np.frombuffer(b"".join(found), np.int64).reshape(-1, size),
                        np.concatenate([[0], np.cumsum([len(x) for x in held])]), np.array([y for x in held for y in x], dtype=object)))
    return Block(vocabulary, phrases)


def phrase_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark's phrases, block by block. Items without words have none; a
    null item id counts as an empty string, repeated ids as one item."""
    held: list[tuple[str, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).filter(F.col(text).isNotNull())
    for name, body in rows.toLocalIterator():
        data, offsets = words.buffers(pa.array([body], pa.string()))
        h, _ = words.scan(data, offsets, words.alphanumeric_class())
        if not len(h):
            continue
        if held and size + len(h) > block_words:
            yield _block(held, window)
            held, size = [], 0
        held.append((name, h))
        size += len(h)
    if held:
        yield _block(held, window)


def _occurrences(block: Block, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(word positions, phrase length, phrase of each, at, items) in one shard."""
    symbol = np.searchsorted(block.vocabulary, h)
    symbol[symbol == len(block.vocabulary)] = 0
    known = block.vocabulary[symbol] == h
    start_of_row = np.zeros(len(h) + 1, dtype=bool)
    start_of_row[first] = True
    opens = known & (start_of_row[:-1] | ~np.concatenate([[False], known[:-1]]))
    closes = known & (start_of_row[1:] | ~np.concatenate([known[1:], [False]]))
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long_enough = e - s >= min(p.shape[1] for p, _, _ in block.phrases)
    s, e = s[long_enough], e[long_enough]
    if not len(s):
        return
    # runs one after the other, each followed by the separator 1, then the end 0
    sizes = e - s
    ends = np.cumsum(sizes + 1)
    origin = np.repeat(s - (ends - sizes - 1), sizes + 1) + np.arange(ends[-1])
    seq = np.ones(ends[-1] + 1, np.int64)
    inside = np.ones(ends[-1], dtype=bool)
    inside[ends - 1] = False
    seq[:-1][inside] = symbol[origin[inside]] + 2
    seq[-1] = 0
    index = FMIndex(seq, len(block.vocabulary) + 2)
    for phrases, at, items in block.phrases:
        which, lo, hi = index.search(phrases)
        if len(which):
            times = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            yield origin[index.locate(rows)], phrases.shape[1], np.repeat(which, times), at, items


def _shard(blocks: Iterator[Block], data: np.ndarray, offsets: np.ndarray):
    """Per row of a shard: words, hit words, item ids and removal spans (code
    points)."""
    h, first, start, end = words.scan(data, offsets, words.alphanumeric_class(), spans=True)
    n = len(offsets) - 1
    change = np.zeros(len(h) + 1, np.int32)
    held: dict[int, set[str]] = {}
    for block in blocks:
        for at_word, size, phrase, at, items in _occurrences(block, h, first):
            np.add.at(change, at_word, 1)
            np.add.at(change, at_word + size, -1)
            row = np.searchsorted(first, at_word, "right") - 1
            for key in np.unique(row * len(at) + phrase):
                r, p = divmod(int(key), len(at))
                held.setdefault(r, set()).update(items[at[p] : at[p + 1]])
    hit = np.cumsum(change[:-1]) > 0
    hits = np.concatenate([[0], np.cumsum(hit)])
    n_hit = hits[first[1:]] - hits[first[:-1]]
    spans: list[list[dict]] = []
    for r in range(n):
        own: list[dict] = []
        if n_hit[r]:
            at = first[r] + np.flatnonzero(hit[first[r] : first[r + 1]])
            cut = np.flatnonzero(np.diff(at) > 1)
            left, right = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            points = np.concatenate([[0], np.cumsum(data[offsets[r] : offsets[r + 1]] & 0xC0 != 0x80)])
            own = [{"start": int(points[a - offsets[r]]), "end": int(points[b - offsets[r]])} for a, b in zip(start[left], end[right])]
        spans.append(own)
    return np.diff(first), n_hit, [sorted(held.get(r, ())) for r in range(n)], spans


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, items (sorted ids as
    strings), spans (merged hit passages as code point ranges) and contaminated
    (``n_hit > 0 and 20 * n_hit >= n_words``).

    A null or empty text has no words and is not contaminated; repeated rows
    each get their result; an empty benchmark hits nothing. New column names
    that ``docs`` has already get an underscore at the end."""
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in phrase_blocks(benchmark, item_id, item_text, window, block_words)]
    place = docs.columns.index(text)
    names = [free_name(docs, prefix + x) for x in ("n_words", "n_hit", "items", "spans", "contaminated")]
    added = ["long", "long", "array<string>", "array<struct<start:long,end:long>>", "boolean"]
    schema = docs.limit(0)
    for name, kind in zip(names, added):
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(place))
            for i, j in words.chunks(offsets, SHARD):
                n_words, n_hit, items, spans = _shard((b.value for b in shared), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                     pa.array(spans, span_type), pa.array((n_hit > 0) & (20 * n_hit >= n_words))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Texts go
    to Python in short batches and don't come back: decisions return by a fingerprint
    of the text, on which alone they depend."""
    at, gone = free_name(docs, "text_key"), free_name(docs, "contaminated_key")
    with short_batches(docs.sparkSession):
        found = find_contamination(docs.select(F.col(text).alias("text")), benchmark)
        flagged = found.filter("contaminated").select(row_key("text").alias(gone)).distinct()
        flagged = keep(flagged, "contaminated", True)
    return docs.withColumn(at, row_key(text)).join(side(flagged), F.col(at) == F.col(gone), "left_anti").drop(at)


def items_digest(items: Column) -> Column:
    """Lowercase hex SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)
