"""Token counts by a two-tier look-up of pre-token lengths, without a shuffle.

A byte-pair tokenizer splits a text into pre-tokens and encodes each on its own,
so a text's count is the sum of its pre-tokens' lengths.

* First tier: a broadcast table of frequent pre-tokens and their lengths, at
  most ``TABLE`` entries of at most ``LONGEST`` characters. It is filled from a
  random sample of about ``WARM`` documents; it is a cache only, so the counts
  are the same whatever it holds.
* Second tier: a cache in each Python worker process, kept from task to task. What
  neither tier has is encoded by the tokenizer, ``SLICE`` pre-tokens at a time, also
  inside one long text; the cache starts anew when it holds ``CACHE`` bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import free_name

TABLE = 1 << 16
LONGEST = 32
WARM = 2048
#: Bytes of cached pre-tokens, each counted with ``ENTRY`` bytes of its own; longer ones
#: than ``CACHED`` characters are not cached.
CACHE = 32 << 20
ENTRY = 120
CACHED = 256
#: Pre-tokens that are looked up and encoded together; longer texts are found in slices.
SLICE = 4096
LONG_TEXT = 1 << 16
ROWS = 256
LIMIT = 512
#: Fixed value: the pre-token pattern that the byte-level tokenizers state.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class Counter:
    """Counts tokens of texts; one per worker."""

    def __init__(self, path: str, table: tuple[str, np.ndarray] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.match = regex.compile(PRE_TOKEN).finditer
        #: strings that the library takes for one token wherever they stand in a text
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.frequent: dict[str, int] = dict(zip(table[0].split("\0"), table[1].tolist())) if table else {}
        self.cache: dict[str, int] = {}
        self.held = 0

    def lengths(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(pieces), SLICE):
            out.extend(len(x.ids) for x in self.tokenizer.encode_batch(pieces[i : i + SLICE], add_special_tokens=False))
        return out

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand between them."""
        if self.cut is None or not self.cut.search(text):
            return self.find(text), 0
        parts = self.cut.split(text)
        return list(chain.from_iterable(map(self.find, parts))), len(parts) - 1

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special strings, a long one's in slices."""
        if len(text) <= LONG_TEXT:
            yield self.find(text)
            return
        found = (m.group() for m in self.match(text))
        while some := list(islice(found, SLICE)):
            yield some

    def _encode(self, waiting: list[tuple[int, str]], totals: list[int]) -> None:
        """Add the lengths of (row, pre-token) pairs that neither tier has."""
        new = list({p for _, p in waiting})
        lengths = dict(zip(new, self.lengths(new)))
        for row, piece in waiting:
            totals[row] += lengths[piece]
        if self.held > CACHE:
            self.cache, self.held = {}, 0
        short = {p: n for p, n in lengths.items() if len(p) <= CACHED}
        self.cache.update(short)
        self.held += sum(map(len, short)) + ENTRY * len(short)
        waiting.clear()

    def count(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        waiting: list[tuple[int, str]] = []
        for row, text in enumerate(texts):
            parts = [text]
            if self.cut is not None and self.cut.search(text):
                parts = self.cut.split(text)
                totals[row] += len(parts) - 1
            for pieces in chain.from_iterable(map(self.pieces, parts)):
                known = list(map(self.frequent.get, pieces))
                left = [p for p, n in zip(pieces, known) if n is None]
                cached = list(map(self.cache.get, left))
                totals[row] += sum(n for n in known if n is not None) + sum(n for n in cached if n is not None)
                waiting.extend((row, p) for p, n in zip(left, cached) if n is None)
                if len(waiting) >= SLICE:
                    self._encode(waiting, totals)
        if waiting:
            self._encode(waiting, totals)
        return totals


_WORKER: dict[str, Counter] = {}


def worker_counter(name: str, path: str, table) -> Counter:
    """The counter of this worker process for one query: made by the first task."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Counter(path, table.value if table is not None else None)
    return _WORKER[name]


def frequent_lengths(docs: DataFrame, text: str, path: str) -> tuple[str, np.ndarray] | None:
    """The first tier, packed: the pre-tokens joined by NUL, and their lengths."""
    rows = docs.count()
    if not rows:
        return None

    sample = uuid.uuid4().hex

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter as Tally
        own = worker_counter(sample, path, None)
        for batch in batches:
            tally = Tally(p for t in batch.column(0).to_pylist() for p in own.split(t)[0] if len(p) <= LONGEST and "\0" not in p)
            yield pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], names=["piece", "n"])

    some = docs.select(text).filter(F.col(text).isNotNull() & (F.rand(11) < WARM / rows))
    top = some.mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE).collect()
    found = [r.piece for r in top]
    return ("\0".join(found), np.array(Counter(path).lengths(found), np.int64)) if found else None


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` plus n_bytes, n_tokens and over_limit
    (``n_tokens > limit``).

    Null and empty texts have no tokens. Special strings inside a text count as
    the tokenizer's one token. Repeated rows each get their count; new column
    names that ``docs`` has already get an underscore at the end."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, tokenizer_path))
    place = docs.columns.index(text)
    names = [free_name(docs, x) for x in ("n_bytes", "n_tokens", "over_limit")]
    schema = docs.limit(0)
    for name, kind in zip(names, ("long", "long", "boolean")):
        schema = schema.withColumn(name, F.lit(None).cast(kind))

    query = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(query, tokenizer_path, table)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                body = pc.fill_null(part.column(place), "")
                tokens = np.array(counter.count(body.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_length(body).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                                                 names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema.schema)
