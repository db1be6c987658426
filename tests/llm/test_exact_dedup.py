"""Exact duplicates against grouping by hand, with and without frequent texts."""

import hashlib
import random
import re

import pytest

from certlens.llm import exact_dedup as X


def norm(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def rows(hot=0.4):
    rng = random.Random(6)
    base = ["".join(rng.choice("ab \té\n") for _ in range(rng.randrange(4))) for _ in range(60)] + [None, "", " ", "\x0b\x0c\r", " ", "\x1c", "x" * 300_000, "x " * 300_000]
    out = []
    for i in range(900):
        text = rng.choice(["very common", "very  common ", "verycommon"]) if rng.random() < hot else rng.choice(base)
        out.append((i, text, rng.choice(["s", None])))
    rng.shuffle(out)
    return out + [(7, "very common", "again"), (7, "very common", "again"), (None, "very  common ", "no id"), (None, "alone, no id", None), (4, "twice", "t"), (4, "twice", "t")]


def expected(data):
    groups = {}
    for i, t, _ in data:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def frame(spark, data):
    return spark.createDataFrame([(*r, "c", 1, True) for r in data], "doc_id long, text string, source string, digest string, row int, kept boolean").repartition(4)


@pytest.mark.parametrize("winners", [1024, 3, 1])
def test_groups(spark, monkeypatch, winners):
    monkeypatch.setattr(X, "WINNERS", winners)
    data = rows()
    got = X.exact_groups(frame(spark, data)).collect()
    groups = expected(data)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == sorted(
        (i, *groups[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in data if i is not None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_winners_are_the_frequent_texts_counted_exactly(spark):
    data = rows()
    slim = X._slim(frame(spark, data), "text", "doc_id")
    winners = {bytes(r.digest): (r["size"], r.best.doc_id) for r in X.frequent_digests(slim).collect()}
    groups = expected(data)
    frequent = {hashlib.sha256(k.encode()).digest(): (n, i) for k, (i, n) in groups.items() if n > 1 and n * X.WINNERS >= len(data)}
    assert winners == frequent and len(winners) <= X.WINNERS


def test_many_texts_beyond_the_counters(spark, monkeypatch):
    monkeypatch.setattr(X, "COUNTERS", 32)
    data = [(i, f"single {i}", None) for i in range(2000)] + [(10_000 + i, "hot", None) for i in range(1500)]
    slim = X._slim(frame(spark, data), "text", "doc_id")
    assert [(r["size"], r.best.doc_id) for r in X.frequent_digests(slim).collect()] == [(1500, 10_000)]
    got = X.exact_groups(frame(spark, data)).collect()
    assert sum(r.kept for r in got) == 2001 and {r.group_size for r in got} == {1, 1500}


def test_frequent_rows_are_not_shuffled(spark):
    slim = X._slim(frame(spark, rows()), "text", "doc_id")
    plan = X._decide(slim, X.frequent_digests(slim))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|MapIn", plan)


def test_drop_copies_keeps_one_row_of_each(spark):
    data = rows()
    df = frame(spark, data)
    left = X.drop_copies(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    groups = expected(data)
    assert len(got) == len(groups) and sorted(map(str, (groups[norm(t)][0] for _, t in got))) == sorted(str(i) for i, _ in got)
    assert {norm(t) for _, t in got} == set(groups)
    only = [(i, t, s) for i, t, s in data if groups[norm(t)][1] == 1]
    assert X.drop_copies(frame(spark, only)).count() == len(only)


def test_reruns_agree_whatever_the_partitions(spark):
    data = rows()
    a = sorted(map(str, X.exact_groups(frame(spark, data)).collect()))
    assert a == sorted(map(str, X.exact_groups(frame(spark, data).repartition(7, "text")).collect()))


def test_empty_table_and_single_rows(spark):
    assert X.exact_groups(frame(spark, [])).count() == 0 and X.drop_copies(frame(spark, [])).count() == 0
    got = X.exact_groups(frame(spark, [(None, None, None)])).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(None, None, 1, True)]
    assert got[0].text_sha256 == hashlib.sha256(b"").hexdigest()
