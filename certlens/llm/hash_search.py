"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

* Codes: iterative quantization (centre, principal axes, rotations learned so that
  signs lose least) on a sample of at most about ``SAMPLE`` rows; several rotations
  side by side give ``BITS`` bits. Every row is coded.
* Index: the rows are dealt into shards; in each, every 8-bit substring of the
  codes has its own table from value to rows.
* Search: for Hamming radius r and m substrings, the substring radii r_j with
  sum(r_j + 1) = r + 1 are probed: by the pigeonhole principle a code within r is
  within r_j in some substring j. Candidates within r are ranked by the Euclidean
  distance of the original vectors in double precision.
* Radius: learned on the sample, so that ``TARGET`` of its rows' true neighbours
  lie within it; the sample is sparser than the table, so the table's neighbours
  are nearer. A shard that holds fewer than k codes within it widens the radius.

Queries are a stated set: they go to the executors in blocks of ``BLOCK`` vectors,
one pass each; equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlens.llm.shared import keep

BITS = 256
SAMPLE = 10_000
PROBES = 300
TARGET = 0.985
ROUNDS = 30
BLOCK = 4096
SHARD_ROWS = 262_144
SEED = 7

_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass
class Codes:
    """The learned code: centre and projection, and the search radius."""

    centre: np.ndarray
    projection: np.ndarray
    radius: int = 0

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes, one row per vector."""
        return np.packbits((x - self.centre) @ self.projection > 0, axis=1)


def _rotation(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    r = np.linalg.qr(rng.normal(size=(p.shape[1], p.shape[1])))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
        r = (u @ v).T
    return r


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def learn(sample: np.ndarray, k: int, bits: int = BITS) -> Codes:
    rng = np.random.default_rng(SEED)
    centre = sample.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov((sample - centre).T, ddof=0).reshape(sample.shape[1], -1))
    axes = axes[:, np.argsort(-values)][:, :bits]
    flat = (sample - centre) @ axes
    rotations = [axes @ _rotation(flat, rng) for _ in range(-(-bits // axes.shape[1]))]
    codes = Codes(centre, np.concatenate(rotations, axis=1)[:, :bits])
    coded = codes.encode(sample)
    apart = []
    for i in rng.choice(len(sample), min(PROBES, len(sample)), replace=False):
        near = np.argsort(_distances(sample, sample[i]), kind="stable")[1 : k + 1]
        apart.append(np.bitwise_count(coded[near] ^ coded[i]).sum(axis=1))
    found = np.concatenate(apart) if apart else np.zeros(0)
    codes.radius = int(np.quantile(found, TARGET)) if len(found) else bits
    return codes


class Shard:
    """Rows of one shard, with a table for each substring of their codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.codes = ids, x, codes
        self.coded = codes.encode(x)
        self.tables = []
        for j in range(self.coded.shape[1]):
            order = np.argsort(self.coded[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(self.coded[order, j], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within ``radius``."""
        m = len(self.tables)
        base, more = divmod(radius + 1, m)
        seen = np.zeros(len(self.ids), dtype=bool)
        for j, (order, at) in enumerate(self.tables):
            near = base + (j < more) - 1
            if near >= 0:
                for v in np.flatnonzero(_DISTANCE[code[j]] <= near):
                    seen[order[at[v] : at[v + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.coded[rows] ^ code).sum(axis=1) <= radius]

    def nearest(self, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows found."""
        radius, bits = self.codes.radius, 8 * len(self.tables)
        rows = self.within(code, radius)
        while len(rows) < min(k, len(self.ids)) and radius < bits:
            radius = min(bits, radius + max(1, bits // 32))
            rows = self.within(code, radius)
        d = _distances(self.x[rows], q)
        best = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[best]], d[best]


def _vectors(rows: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r[0] for r in rows], np.int64)
    return ids, np.array([r[1] for r in rows], np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance), nearest
    first, ties to the smaller vec_id; a query never finds its own row.

    Rows with a null id take no part, nor do vectors that are null, empty, zero,
    or hold null or non-finite components, nor those of another length than most
    of the table's. Equal vectors under different ids are all candidates; a
    repeated row counts once. Different vectors under one id are rows of their own:
    each is a candidate (for the others too), and each of a query's is searched. No usable vectors: an empty result."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(vec_id).cast("long").alias("id"), v.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & fine)

    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_rows = usable(vectors)
    sizes = all_rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return empty
    width, total = sizes
    all_rows = all_rows.filter(F.size("x") == width)
    sample = all_rows.filter(F.rand(SEED) < SAMPLE / total).limit(2 * SAMPLE).toArrow().column("x").combine_chunks()
    flat = sample.flatten().to_numpy().reshape(-1, width)
    if len(flat) < 2:
        flat = np.array([r.x for r in all_rows.limit(SAMPLE).collect()])
    codes = spark.sparkContext.broadcast(learn(flat, k))
    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_ROWS))
    dealt = all_rows.dropDuplicates(["id", "x"]).repartition(shards)
    found = spark.createDataFrame([], "query_id long, point long, vec_id long, score double")

    def search(block) -> DataFrame:
        ids, x = _vectors(block)
        points_of = np.array([r[2] for r in block], np.int64)
        distinct, which = np.unique(x, axis=0, return_inverse=True)
        shared = spark.sparkContext.broadcast((ids, points_of, distinct, which.reshape(-1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, width)) for b in batches if b.num_rows]
            if not parts:
                return
            shard = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), codes.value)
            query_ids, marks, points, of = shared.value
            coded = codes.value.encode(points)
            hits = [shard.nearest(q, c, k + 1) for q, c in zip(points, coded)]
            for i in range(0, len(query_ids), 1024):
                out = []
                for name, mark, p in zip(query_ids[i : i + 1024], marks[i : i + 1024], of[i : i + 1024]):
                    own, d = hits[p]
                    other = (own != name) | (d > 0)
                    n = min(k, other.sum())
                    out.append((np.full(n, name), np.full(n, mark), own[other][:k], d[other][:k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], names=["query_id", "point", "vec_id", "score"])

        return keep(dealt.mapInArrow(run, "query_id long, point long, vec_id long, score double"), "ann-found")

    block: list = []
    for row in usable(queries).filter(F.size("x") == width).dropDuplicates(["id", "x"]).withColumn("point", F.xxhash64("x")).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found = found.unionByName(search(block))
            block = []
    if block:
        found = found.unionByName(search(block))
    order = Window.partitionBy("query_id", "point").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
