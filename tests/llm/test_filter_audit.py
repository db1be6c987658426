"""Decision diagrams against counting by hand, and the audit of odd rows."""

import itertools
import random
import re

from certlens.llm import filter_audit as audit


def plain(counts, names):
    n = len(names)
    out = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            here = [c for m, c in counts.items() if m & bit and not m & before]
            kept = sum(c[0] for m, c in counts.items() if not m & (before | bit))
            removed = sum(c[0] for c in here)
            redundant = sum(c[0] for m, c in counts.items() if m & bit and m & before)
            out.append(["".join(names[i] for i in order), step, kept, removed, redundant, counts.get(bit, (0, 0, 0))[0], sum(c[1] for c in here), sum(c[2] for c in here)])
            before |= bit
    total = {f: sum(r[3] for r in out if r[0][r[1] - 1] == f) for f in names}
    return sorted((*r, total[r[0][r[1] - 1]]) for r in out)


def test_adjacent_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), [tuple(range(n))]
        for at in audit.adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) and sorted(seen) == sorted(itertools.permutations(range(n)))


def test_every_order_and_step_matches_counting():
    rng = random.Random(2)
    for n in (1, 2, 3, 5):
        for size in (0, 1, 3, 2**n):
            counts = {m: (k := rng.randrange(1, 9), rng.randrange(k + 1), rng.randrange(k + 1)) for m in rng.sample(range(2**n), min(size, 2**n))}
            assert sorted(audit.audit_counts(counts, "ABCDE"[:n])) == plain(counts, "ABCDE"[:n])


def test_swaps_keep_the_function_and_share_nodes():
    rng = random.Random(8)
    counts = {m: (rng.randrange(3), 0, 0) for m in range(32)}
    diagram = audit.Diagram(counts, 3, 5)

    def value(mask):
        node = diagram.root
        for level, f in enumerate(diagram.order):
            node = diagram.levels[level][node][mask >> f & 1]
        return diagram.ends[node]

    for at in audit.adjacent_swaps(5):
        diagram.swap(at)
        assert all(value(m) == counts[m] for m in counts)
        assert all(len(nodes) == len(set(nodes)) for nodes in diagram.levels)
    equal = audit.Diagram({m: (1, 0, 0) for m in range(32)}, 3, 5)
    assert [len(x) for x in equal.levels] == [1] * 5


def mask(doc_id, text, rows):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
    return ((len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
            + 8 * bool(re.search(r"[#$%&*|]", text)) + 16 * copy)


def rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["one", "Two", "THREE", "four five", "six", "é", "x%", "Ω"]) + str(rng.randrange(60))
    texts = [None, "", " \t\n", "A", "a" * 20 + "B", "#", "a\x0bb\x0cc\rd"] + [rng.choice([" ", "\n", " \t "]).join(word() for _ in range(rng.choice([3, 49, 50, 51, 80, 300]))) for _ in range(120)]
    texts += rng.choices(texts, k=80) + ["same text of all"] * 100 + ["long word " * 40_000]
    data = [(i, t, rng.choice(["a", "a", "a", "b", None, ""]), "x", 9) for i, t in enumerate(texts)]
    rng.shuffle(data)
    return data + [(None, "same text of all", "a", "x", 9), (3, "again", "b", "x", 9), (3, "again", "b", "x", 9), (2, "again", "b", None, None)]


def frames(spark, data, labels):
    return (spark.createDataFrame(data, "doc_id long, text string, source string, mask string, digest int").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string"))


LABELS = [(i, i % 2, i % 3 == 0 and 1 or 0, "p") for i in range(0, 200, 2)] + [(1, None, 1, "p"), (1, 1, 0, "p"), (None, 1, 1, "p"), (5, 7, 7, "p"), (10**6, 1, 1, "p")]


def test_masks_and_labels(spark):
    data = rows()
    got = audit.failure_masks(*frames(spark, data, LABELS)).collect()
    good = {i for i, q, _, _ in LABELS if q == 1}
    toxic = {i for i, _, t, _ in LABELS if t == 1}
    expected = [(i, s or "", mask(i, t, data), int(i is not None and i in good), int(i is not None and i in toxic)) for i, t, s, *_ in data]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_audit_of_whole_table(spark):
    data = rows()
    masks = audit.failure_masks(*frames(spark, data, LABELS))
    counts = {}
    for r in masks.collect():
        n, g, t = counts.setdefault(r.part, {}).get(r["mask"], (0, 0, 0))
        counts[r.part][r["mask"]] = (n + 1, g + r.good, t + r.toxic)
    got = audit.audit(masks).collect()
    assert set(counts) == {"", "a", "b"} and len(got) == 3 * 600
    for part in counts:
        assert sorted(tuple(r)[1:] for r in got if r.part == part) == plain(counts[part], "ABCDE")
    last = [r.kept for r in got if r.step == 5 and r.part == "a"]
    assert len(set(last)) == 1


def test_empty_tables(spark):
    docs, labels = frames(spark, [], LABELS)
    assert audit.audit(audit.failure_masks(docs, labels)).collect() == []
    docs, labels = frames(spark, [(1, None, None, None, None)], [])
    got = audit.audit(audit.failure_masks(docs, labels)).collect()
    assert len(got) == 600 and {(r.part, r.good_lost) for r in got} == {("", 0)}
    assert {(r.removed, r.unique_fails, r.shapley) for r in got if r.filter_order[r.step - 1] == "A"} == {(1, 1, 120)}
