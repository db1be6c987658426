"""FM-index and decontamination against plain search."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from certlens.llm import decontaminate
from certlens.llm.fm_index import Bits, FMIndex, WaveletMatrix, suffix_order


@given(st.lists(st.integers(0, 9), max_size=300))
@settings(max_examples=60, deadline=None)
def test_bits_and_wavelet_matrix(symbols):
    row = np.array(symbols, np.int64)
    bits = Bits(row % 2 == 1)
    at = np.arange(len(row) + 1)
    assert bits.rank(at).tolist() == [int((row[:i] % 2).sum()) for i in at]
    tree = WaveletMatrix(row, 10)
    for c in range(10):
        assert tree.rank(np.full(len(at), c), at).tolist() == [int((row[:i] == c).sum()) for i in at]
    if len(row):
        c, before = tree.access_rank(np.arange(len(row)))
        assert c.tolist() == symbols and before.tolist() == [symbols[:i].count(x) for i, x in enumerate(symbols)]


@given(st.lists(st.integers(1, 4), max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=10))
@settings(max_examples=80, deadline=None)
def test_index_finds_every_occurrence(text, patterns):
    seq = np.array([*text, 0], np.int64)
    assert suffix_order(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    index = FMIndex(seq, 5)
    which, lo, hi = index.search(np.array(patterns, np.int64))
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
    for k, p in enumerate(patterns):
        assert found.get(k, []) == [i for i in range(len(text) - 2) if text[i : i + 3] == p]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    phrases = {}
    for item, text in items:
        w = words_of(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in phrases:
                    hit.update(range(i, i + size))
                    names |= phrases[tuple(w[i : i + size])]
        out.append((doc_id, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(7)).repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(d, b, **more)
    assert {"items", "items_"} <= set(got.columns)
    return got


def rows(got):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items_, r.contaminated) for r in got.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    v = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([0, 1, 5, 13, 14, 30])))) for i in range(25)] + [(None, "w1 w2 w3"), (3, "repeated id item w5"), (40, None)]
    docs = []
    for i in range(60):
        w = rng.choices(v, k=rng.choice([0, 10, 200]))
        for _ in range(rng.choice([0, 1, 2])):
            source = words_of(rng.choice(items)[1])
            at = rng.randrange(len(w) + 1)
            w[at:at] = source if rng.random() < 0.7 else source[: len(source) // 2]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(None, None), (70, ""), (1, docs[1][1]), (71, "--- !!")]
    expected = brute(docs, items)
    assert rows(run(spark, docs, items)) == expected
    assert rows(run(spark, docs, items, block_words=40)) == expected  # in blocks


def test_spans_are_merged_code_points(spark):
    item = " ".join(f"é{i}" for i in range(15))
    text = "Ünrelated start: " + item.upper().replace("É", "é") + " / the end " + item
    got = run(spark, [(1, text)], [(9, item)]).first()
    assert [text[s.start : s.end] for s in got.spans] == [item, item]
    assert got.n_hit == 30


def test_empty_benchmark_and_empty_documents(spark):
    assert rows(run(spark, [(1, "a b")], [])) == [(1, 2, 0, [], False)]
    assert rows(run(spark, [], [(1, "a b")])) == []


def test_contaminated_rows_go_and_clean_ones_stay(spark):
    phrase = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, phrase), (2, phrase + " x" * 300), (3, "clean"), (4, None)], "doc_id long, text string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns


def test_digest(spark):
    import hashlib

    got = spark.createDataFrame([(["2", "10"],), ([],)], "items array<string>").select(decontaminate.items_digest(F.col("items")).alias("d"))
    assert [r.d for r in got.collect()] == [hashlib.sha256(b"10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_texts_reach_workers_in_short_batches_and_only_decisions_return(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    docs = spark.range(2_500).select("id", F.when(F.col("id") % 50 == 0, phrase).when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("w1 w2 "), F.col("id"))).alias("text")).coalesce(1)
    docs = docs.union(docs.filter("id < 4"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # no text comes back from Python
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    rows = kept.collect()
    assert len(rows) == 2_450 + 3 and all(r.id % 50 for r in rows) and sum(r.text is None for r in rows) == 51
    assert kept.columns == docs.columns
