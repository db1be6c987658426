"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from certlens.llm import hash_search as S


def brute(ids, x, query_ids, k=10):
    out = {}
    for q in query_ids:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((dist, v) for dist, v in zip(d.tolist(), ids) if v != q)[:k]
        out[q] = order
    return out


def test_pigeonhole_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    codes = S.learn(x, 5, bits=64)
    shard = S.Shard(np.arange(500), x, codes)
    for q in range(0, 500, 50):
        apart = np.bitwise_count(shard.coded ^ shard.coded[q]).sum(axis=1)
        for radius in (0, 3, 7, 8, 20, 64):
            assert shard.within(shard.coded[q], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in S.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    expected = brute(ids, x, [i for i in ids if i % 100 == 0])
    assert got.keys() == expected.keys() and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({v for _, v in got[q]} & {v for _, v in expected[q]}) / 10 for q in expected])
    assert recall >= 0.95
    for q, found in got.items():
        assert found == sorted(found)
        for score, v in found:
            assert score == pytest.approx(np.linalg.norm(x[ids.index(v)] - x[ids.index(q)]), abs=1e-12)


def test_ties_copies_and_unusable_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 30)] + [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 0.0]),
            (205, [1.0, float("inf"), 0.0]), (None, same), (206, [1.0, 2.0]), (300, [1.0, 2.0, 4.0]), (300, [1.0, 2.0, 4.0]), (5, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(4)
    got = {}
    for r in S.nearest(df, df.filter("vec_id IN (0, 5, 300, 200, 204)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {0: [(i, i, 0.0) for i in range(1, 11)], 5: [(i + 1, v, 0.0) for i, v in enumerate([0, 1, 2, 3, 4, 6, 7, 8, 9, 10])], 300: [(i + 1, i, 1.0) for i in range(10)]}


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], schema)
    got = S.nearest(three, three.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    one = three.filter("vec_id = 0")
    assert S.nearest(one, one).count() == 0
    assert S.nearest(one.limit(0), one.limit(0)).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = df.filter("vec_id % 20 = 0")
    whole = S.nearest(df, queries).collect()
    monkeypatch.setattr(S, "BLOCK", 4)
    assert sorted(map(str, S.nearest(df, queries).collect())) == sorted(map(str, whole))


def test_different_vectors_under_one_id(spark):
    rows = [(100, [1.0, 0.0]), (1, [0.0, 0.0001]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (100, [5.0, 0.0])]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = S.nearest(df, df.filter("vec_id = 100")).collect()
        of_first = [(1, 0.1), (1, float(np.hypot(1, 0.0001))), (100, 4.0)]
        of_last = [(100, 4.0), (1, float(np.hypot(4, 0.1))), (1, float(np.hypot(5, 0.0001)))]
        expected = [(100, k + 1, v, round(d, 9)) for found in (of_first, of_last) for k, (v, d) in enumerate(found)]
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(expected)
