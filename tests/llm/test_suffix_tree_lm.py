"""Suffix-tree scores against a plain model of the same definition."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from certlens.llm import suffix_tree_lm as lm


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) of every row, and the
    retained contexts by the length of their grams."""
    seqs = [["<s>", *(text or "").encode().lower().split(), "</s>"] for _, text in rows]
    held = [doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in rows]
    train = [s for s, h in zip(seqs, held) if not h]
    c = Counter(w for s in train for w in s[1:])
    total, distinct = sum(c.values()), len(c)
    root = lambda w: (c[w] + 1) / (total + distinct + 1)
    kept, pairs, n = {}, {}, 1
    while n < 3 or kept[n]:
        n += 1
        grams = Counter(tuple(s[i : i + n]) for s in train for i in range(len(s) - n + 1))
        pairs = grams if n == 2 else pairs
        followed = Counter()
        for g, k in grams.items():
            followed[g[:-1]] += k
        size = {2: lambda ctx: len(train) if ctx == ("<s>",) else c[ctx[0]], 3: lambda ctx: pairs[ctx]}.get(n, followed.__getitem__)
        shorter = lambda ctx, w: kept[n - 1][ctx[1:]][1].get(w) if n > 2 and ctx[1:] in kept[n - 1] else None
        by_context = {}
        for g, k in grams.items():
            # beyond two words a context grows only where the shorter one was retained
            if k >= 2 and (n < 4 or shorter(g[:-1], g[-1]) is not None):
                by_context.setdefault(g[:-1], {})[g[-1]] = k
        kept[n] = {}
        for ctx, nexts in by_context.items():
            whole = size(ctx)
            rest = max(1 - sum((k - 0.5) / whole for k in nexts.values()), 1e-12)
            parent = {w: shorter(ctx, w) or root(w) for w in nexts}
            p = {w: (k - 0.5) / whole + rest * parent[w] for w, k in nexts.items()}
            gain = sum(k * math.log(p[w] / parent[w]) for w, k in nexts.items()) + (whole - sum(nexts.values())) * math.log(rest)
            if gain > 0.5 * len(nexts) * math.log(whole):
                kept[n][ctx] = (rest, p)

    def prob(s, i):
        out = root(s[i])
        for n in sorted(kept):
            ctx = tuple(s[i - n + 1 : i]) if i - n + 1 >= 0 else None
            if ctx in kept[n]:
                rest, p = kept[n][ctx]
                out = p[s[i]] if s[i] in p else rest * out
        return out

    return [(doc, h, len(s) - 1, sum(c[w] > 0 for w in s[1:]), total, sum(math.log10(root(w)) for w in s[1:]), sum(math.log10(prob(s, i)) for i in range(1, len(s))))
            for (doc, _), s, h in zip(rows, seqs, held)], {n: x for n, x in kept.items() if x}


def corpus(n=150):
    rng = random.Random(2)
    phrases = [" ".join(rng.choices([f"w{i}" for i in range(80)], k=rng.choice([2, 4, 9]))) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(phrases, k=rng.randrange(12)) + [f"Rare{i}"])) for i in range(n)]
    return rows + [(None, None), (None, "w1 w2"), (7, ""), (7, rows[7][1]), (8, " \n"), (9, "unseen" + "x" * 2000)]


def test_scores_match_the_definition(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=lambda r: str(r[:4]))
    expected, kept = plain(rows)
    expected.sort(key=lambda r: str(r[:4]))
    assert max(kept) >= 4
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for g, e in zip(sorted(r[5:] for r in got), sorted(r[5:] for r in expected)):
        assert g == pytest.approx(e, rel=1e-9)


def test_held_out_text_is_predicted_better_than_by_words(spark):
    rows = [r for r in corpus(400) if r[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(df).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 50


def test_empty_tables(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(only_held, held=F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_the_tree_grows_with_the_corpus_and_contexts_beyond_two_words(spark):
    # a phrase seen twice in a corpus that is three million words long
    filler = [(i, " ".join(f"z{(i * 7 + k) % 900}" for k in range(20_000))) for i in range(150)]
    phrase = [(1000 + i, "p q r s t") for i in range(3)]
    df = spark.createDataFrame(filler + phrase, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, held=F.col("doc_id") == 1002).filter("doc_id >= 1000").collect()}
    assert got[1002].held_out and got[1002].train_tokens > 3_000_000
    assert got[1002].score > got[1002].base_score + 20

    # what follows "y r" depends on the word before it
    rng = random.Random(5)
    rows = [(i, f"a{i % 4} u{rng.randrange(40)} v{rng.randrange(2)} r b{i % 4}") for i in range(300)]
    rows += [(1000 + i, f"a{i % 4} y r c{i % 4} e") for i in range(400)]
    deep = spark.createDataFrame(rows, "doc_id long, text string")
    tree, slots, _, _ = lm.learn(deep.select(F.lit(0).cast("long").alias("piece"), "text"))
    assert max(slots) >= 4 and tree.count() > 0
    r = lm.score(deep, held=F.col("doc_id") == 1399).filter("held_out").first()
    assert r.score > r.base_score + 5


def test_many_small_ranges_and_passes_give_the_same_scores(spark, monkeypatch):
    for name, value in (("FIRST", (2, 2)), ("MORE", 1), ("MEET", 64), ("SHARES", 3)):
        monkeypatch.setattr(lm, name, value)
    asked = []
    requests = lm._requests
    monkeypatch.setattr(lm, "_answers", lambda *a, whole=lm._answers: (asked.append(1), whole(*a))[1])
    monkeypatch.setattr(lm, "_requests", lambda orders, *a: requests(orders, *a) if orders == (2,) else 1 / 0)
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=lambda r: str(r[:4]))
    expected = sorted(plain(rows)[0], key=lambda r: str(r[:4]))
    assert asked == [1]  # pieces ask for one level only, longer contexts are scored where they are counted
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for g, e in zip(sorted(r[5:] for r in got), sorted(r[5:] for r in expected)):
        assert g == pytest.approx(e, rel=1e-9)


def test_tables_between_the_steps_hold_packed_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=200))) for i in range(300)]
    written = []

    def counted(write):
        def run(*a, **k):
            out = write(*a, **k)
            written.append(out.count())
            return out
        return run

    for name in ("keep", "keep_parts"):
        monkeypatch.setattr(lm, name, counted(getattr(lm, name)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).agg(F.sum("n_tokens")).first()[0]
    assert got == 300 * 201
    # one row for each piece or each piece and range, not one for each word or gram
    assert sum(written) < got / 500


def test_hot_words_give_the_same_tree_and_scores(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(w for _ in range(30) for w in ("the", rng.choice(names), rng.choice(["of the", "of", "x y z"])))) for i in range(150)]
    rows += [(1000 + i, "the") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def found():
        tree, slots, total, distinct = lm.learn(df.select("text"))
        scores = {(r.doc_id, r.n_tokens, r.n_known): (r.base_score, r.score) for r in lm.score(df).collect()}
        return {r.h: (r.p, r.rest) for r in tree.fillna(9.0).collect()}, {n: x.sum() for n, x in slots.items()}, (total, distinct), scores

    whole = found()
    asked, requests = [], lm._requests
    monkeypatch.setattr(lm, "_requests", lambda *a: (asked.append(a[-1].times), requests(*a))[1])
    monkeypatch.setattr(lm, "MEET", 100)
    hot = found()
    assert len(asked) == 2 and all(len(x) > 10 and x.max() > 4000 for x in asked)  # also the start mark, 200 times
    assert hot[1:3] == whole[1:3] and hot[0].keys() == whole[0].keys() and hot[3].keys() == whole[3].keys()
    for a, b in ((hot[0], whole[0]), (hot[3], whole[3])):
        for key in a:
            assert a[key] == pytest.approx(b[key], rel=1e-9)
    expected = plain(rows)[0]
    assert sorted(s for _, s in hot[3].values()) == pytest.approx(sorted({r[0]: r[6] for r in expected}.values()), rel=1e-9)
