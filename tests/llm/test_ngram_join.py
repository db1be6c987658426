"""The n-gram Jaccard join against brute force over all pairs."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from certlens.llm import ngram_join
from certlens.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """Row index -> (n, component id) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, a in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(a), min(ids, default=None) if a else rows[i][0]))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_components(df.withColumn("cls", F.lit("x")).withColumn("n", F.lit(1.5)))
    return sorted(map(tuple, got.collect()), key=str)


def test_chains_copies_and_shared_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=25)
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 12, 60, 120]))
        if i % 3 == 0:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4])):  # a chain: each changes a little of the one before
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(base).upper() if rng.random() < 0.3 else " ".join(base)))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(80)] = f"r{rng.randrange(30)}"
        rows.append((1000 - i, " ".join(own)))
    assert run(spark, rows) == brute(rows)


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (None, "one two"), (4, "one two"), (None, None), (6, "x y z u v w"), (None, "q")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (7, None), (8, ""), (8, ""), (9, "other words here"), (None, "p q"), (None, "p q")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at int")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(3, "A b c d e f"), (7, None), (8, ""), (8, ""), (9, "other words here"), (None, "p q")], key=str)


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (95, 100), (7, 7), (200, 199)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, 95: 90, 100: 90, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_templates_below_the_threshold_and_copies_among_them(spark):
    """Texts that share about 85 % of one template (similarity below 0.8), in
    sizes on both sides of a size band, with near copies of some of them."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(70)]
    rows = []
    for i in range(90):
        own = template[: 60 + i % 11] + [f"o{i}x{k}" for k in range(9 + i % 7)]
        rows.append((len(rows), " ".join(own)))
        if i % 4 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own)))
    assert run(spark, rows) == brute(rows)


def test_tables_go_when_their_last_reader_is_done(spark):
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(300)], k=80)
    rows = [(i, " ".join(base[: 80 - i % 7])) for i in range(100)]  # one hub, more pairs than a group holds
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    assert run(spark, rows) == brute(rows)
    left = {p.name.split("-")[2] for p in set(folder.glob("llm-jaccard-*")) - before}
    assert {"classes", "members"} <= left and not left & {"rows", "met", "sets", "leaders", "alike", "named"}
    kept = [str(p) for p in set(folder.glob("llm-jaccard-near-*")) - before]  # the empty ones are results
    assert not kept or spark.read.parquet(*kept).count() == 0
    assert not [p for p in set(folder.glob("llm-sketch-*")) - before]


def test_texts_reach_workers_in_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    sketched = ngram_join.sketch.gather
    try:
        ngram_join.sketch.gather = lambda counts: (seen.append(int(spark.conf.get(name))), sketched(counts))[1]
        rows = [(i, f"a b c d e f g h {i}") for i in range(3)]
        assert run(spark, rows) == brute(rows)
    finally:
        ngram_join.sketch.gather = sketched
    assert seen == [min(1000, int(before))] and spark.conf.get(name) == before
