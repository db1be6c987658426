"""Mixing against plain water-filling."""

import random

import pytest

from certlens.llm import mixing


def plain_targets(sizes, share=1.0, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, full = sum(sizes.values()) * share, set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(epochs * sizes[s] for s in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        full |= over


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string").repartition(3)


ROWS = [(i, random.Random(i).choice(["a", "Z", "é", "big", "big", "big", "big", None]), "w " * random.Random(-i).randrange(80), "x") for i in range(400)]


def test_targets_and_taken_words(spark):
    got = mixing.mix(docs_of(spark, ROWS)).collect()
    sizes = {}
    for _, s, t, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.extra
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: int(target[s] + 0.5) for s in sizes}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in ROWS)
    assert sum(0 < r.extra < r.size for r in got) <= len(sizes)


def test_small_sources_stop_at_three_epochs(spark):
    rows = [(1, "a", "w " * 1000, ""), (2, "b", "w w", ""), (3, "c", "w", ""), (4, "d", "", ""), (5, "d", None, "")]
    got = {r.doc_id: r for r in mixing.mix(docs_of(spark, rows)).collect()}
    assert (got[2].target, got[2].taken, got[3].target, got[3].taken) == (6.0, 6, 3.0, 3)
    assert got[1].target == 1003 - 9 and got[1].taken == 994
    assert got[4].taken == got[5].taken == 0 and got[4].target == 0


def test_reruns_agree_whatever_the_partitions(spark):
    a = mixing.mix(docs_of(spark, ROWS)).collect()
    b = mixing.mix(docs_of(spark, ROWS).repartition(7, "text")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_buckets_do_not_change_the_result(spark, monkeypatch):
    whole = mixing.mix(docs_of(spark, ROWS)).collect()
    monkeypatch.setattr(mixing, "BUCKET", 10)
    assert sorted(map(str, mixing.mix(docs_of(spark, ROWS)).collect())) == sorted(map(str, whole))


def test_empty_table_and_empty_texts(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, "a", None, ""), (None, None, " ", "")])).collect()] == [0, 0]
    assert mixing.mixture(docs_of(spark, [])).count() == 0


def test_mixture_repeats_and_cuts(spark):
    docs = docs_of(spark, ROWS + [(7, "a", "dup dup", "x"), (7, "a", "dup dup", "x"), (None, None, "n n n", None)])
    plan = mixing.mix(docs).collect()
    out = mixing.mixture(docs, length="size").collect()
    assert sum(r.taken for r in out) == sum(r.taken for r in plan)
    for r in out:
        assert len(r.text.split()) == r.taken
    per_doc = {}
    for r in out:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.taken
    expected = {}
    for r in plan:
        if r.taken:
            expected[r.doc_id] = expected.get(r.doc_id, 0) + r.taken
    assert per_doc == expected


def test_level_of_many_caps(spark):
    rng = random.Random(4)
    sizes = {f"s{i:03}": rng.choice([1, 5, 40, 1000, 9000]) for i in range(60)}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
