"""The count sketch: packed blocks, sums over tasks, no undercount."""

import numpy as np
import pyarrow as pa
import pytest

from certlens.llm import sketch


@pytest.mark.parametrize("share, most", [(0.0, 1), (0.01, 3), (0.9, 5), (0.9, 5000)])
def test_blocks_add_up(share, most):
    rng = np.random.default_rng(0)
    counts = np.where(rng.random(sketch.SLOTS) < share, rng.integers(1, most + 1, sketch.SLOTS), 0).astype(np.uint32)
    rows = sketch.blocks(counts, 3)
    out = np.zeros((sketch.BLOCKS, sketch.WIDTH), np.uint64)
    for batch in sketch._sum(iter([rows, rows])):
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            sketch._add(out[block], raw)
    assert (out.reshape(-1) == 2 * counts.astype(np.uint64)).all()


def test_gather_over_tasks(spark):
    df = spark.range(100, numPartitions=7).selectExpr("CAST(id AS STRING) AS text")

    def count(batches):
        counts = np.zeros(sketch.SLOTS, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[int(text) * 1000] += 2
        return counts

    total = sketch.gather(sketch.tasks(df, count))
    assert total.sum() == 200 and (total[np.arange(100) * 1000] == 2).all()


def test_an_empty_task_emits_nothing():
    assert sketch.blocks(np.zeros(sketch.SLOTS, np.uint32), 0).num_rows == 0
    assert list(sketch._sum(iter([]))) == []
    assert isinstance(sketch.blocks(np.zeros(sketch.SLOTS, np.uint32), 0), pa.RecordBatch)
