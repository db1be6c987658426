"""A count sketch of fixed width over the whole corpus, summed by Spark.

Every task counts into its own array of ``SLOTS`` counters and emits it as
``BLOCKS`` rows; two rounds of repartitioning add the blocks up. Only the final
array (``SLOTS`` x 4 bytes, a fixed bound) reaches the driver and is broadcast.
Slots never undercount. Counters saturate at 2^32 - 1. A block travels in the
smallest of three forms: single bytes, full counters, or the counted slots alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import discard, keep

SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
BLOCKS = 64
WIDTH = SLOTS // BLOCKS
SCHEMA = "block int, salt int, counts binary"
_MOST = 2**32 - 1


def slot(h: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def count(counts: np.ndarray, h: np.ndarray) -> None:
    """Add one for each hash to a task's counters, in place."""
    np.add.at(counts, slot(h), counts.dtype.type(1))


def _packed(counts: np.ndarray) -> bytes:
    some = np.flatnonzero(counts)
    if 8 * len(some) < WIDTH:
        return b"s" + some.astype(np.uint32).tobytes() + counts[some].astype(np.uint32).tobytes()
    if counts.max() < 256:
        return b"b" + counts.astype(np.uint8).tobytes()
    return b"f" + counts.astype(np.uint32).tobytes()


def _add(total: np.ndarray, raw: bytes) -> None:
    """Add a packed block to 64-bit counters."""
    kind, body = raw[:1], raw[1:]
    if kind == b"s":
        half = len(body) // 2
        total[np.frombuffer(body[:half], np.uint32)] += np.frombuffer(body[half:], np.uint32)
    else:
        total += np.frombuffer(body, np.uint8 if kind == b"b" else np.uint32)


def blocks(counts: np.ndarray, salt: int) -> pa.RecordBatch:
    """A task's counters as rows; blocks without a count are left out."""
    parts = counts.reshape(BLOCKS, WIDTH)
    some = [b for b in range(BLOCKS) if parts[b].any()]
    return _rows(some, [salt] * len(some), [_packed(parts[b]) for b in some])


def _rows(keys: list[int], salts: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(salts, pa.int32()), pa.array(packed, pa.binary())], names=["block", "salt", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
            if b not in total:
                total[b] = np.zeros(WIDTH, np.uint64)
            _add(total[b], raw.as_py())
    if total:
        keys = sorted(total)
        yield _rows(keys, [0] * len(keys), [_packed(np.minimum(total[b], _MOST)) for b in keys])


def gather(per_task: DataFrame) -> np.ndarray:
    """The corpus-wide counters from the rows of all tasks."""
    once = per_task.repartition(F.col("block"), F.col("salt")).mapInArrow(_sum, SCHEMA)
    whole = keep(once.repartition(F.col("block")).mapInArrow(_sum, SCHEMA), "sketch", True)
    out = np.zeros((BLOCKS, WIDTH), dtype=np.uint64)
    for row in whole.collect():  # at most BLOCKS rows, SLOTS x 4 bytes in all
        _add(out[row.block], bytes(row.counts))
    discard(whole)
    return out.reshape(-1).astype(np.uint32)


def tasks(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> DataFrame:
    """Run ``count`` over each partition and emit its counters. Sixteen salts
    spread a block's rows before the second round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        context = TaskContext.get()
        yield blocks(count(batches), (context.partitionId() if context else 0) % 16)

    return df.mapInArrow(run, SCHEMA)
