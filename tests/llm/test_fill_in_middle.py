"""Boundary sets against sorted lists, and fill-in-the-middle against plain strings."""

import hashlib
import random

import numpy as np
import pytest

from certlens.llm import boundary_set as B
from certlens.llm import fill_in_middle as fim


def sets_of_all_forms():
    rng = random.Random(3)
    few = sorted(rng.sample(range(60_000), 500))
    half = sorted(rng.sample(range(65_536), 30_000))
    runs = [x for s in range(0, 60_000, 3_000) for x in range(s, s + 2_000)]
    far = [5, 70_000, 70_001, 400_000, 65_536 * 9 - 1, 65_536 * 9]
    mixed = few + [65_536 + x for x in half] + [4 * 65_536 + x for x in runs]
    return {"array": few, "bitmap": half, "run": runs, "far": far, "mixed": mixed, "none": [], "one": [0]}


@pytest.mark.parametrize("name", ["array", "bitmap", "run", "far", "mixed", "none", "one"])
def test_rank_and_select(name):
    offsets = sets_of_all_forms()[name]
    held = B.BoundarySet.of(np.array(offsets, np.int64))
    assert len(held) == len(offsets)
    if name in ("array", "bitmap", "run"):
        assert [c.form for c in held.containers] == [name]
    if name == "mixed":
        assert {c.form for c in held.containers} == {"array", "bitmap", "run"}
    places = range(0, len(offsets), max(1, len(offsets) // 400))
    assert [held.select(k) for k in places] == [offsets[k] for k in places]
    for x in [0, 1, 63, 64, 65_535, 65_536, 131_072, 10**6, *offsets[:50], *(y + 1 for y in offsets[-50:])]:
        assert held.rank(x) == int(np.searchsorted(offsets, x))


def test_containers_are_the_smallest_form():
    for offsets in sets_of_all_forms().values():
        for c in B.BoundarySet.of(np.array(offsets, np.int64)).containers:
            n = {"array": lambda: len(c.low), "run": lambda: int(c.lengths.sum()), "bitmap": lambda: int(c.up_to[-1])}[c.form]()
            assert c.bytes <= min(2 * n if n <= B.ARRAY_MOST else 8192, 8192)


@pytest.mark.parametrize("text", ["", "a", "aé", "😀", "ёж и уж\nlines\n\n", "x" * 70_000, "né " * 30_000, "\n"])
def test_boundaries_of_units(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum([0, *(len(c.encode()) for c in text)])
    chars = B.boundaries(data)
    assert len(chars) == len(text) + 1 and all(chars.select(k) == ends[k] for k in range(0, len(text) + 1, max(1, len(text) // 300)))
    lines = B.boundaries(data, "line")
    cuts = sorted({0, len(data), *(int(ends[i + 1]) for i, c in enumerate(text) if c == "\n")})
    assert [lines.select(k) for k in range(len(lines))] == cuts
    words = B.boundaries(data, "word")
    marks = [words.select(k) for k in range(len(words))]
    assert "".join(text.encode()[a:b].decode() for a, b in zip(marks, marks[1:])) == text


def plain(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(5)
    odd = [None, "", "a", "é", "😀😀", "a<P>b", "<", "<<S", "P>", "<P", "nul\0inside", "line\n\r\n", "<S><M>", "M>x<"]
    texts = odd + ["".join(rng.choice("ab <>PSM é😀\n") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    long = ["ab é" * 60_000, "x" * 200_000]
    return [*enumerate(texts + long), (None, "no id"), (7, "same"), (7, "same"), (-3, "negative id")]


def test_matches_plain_strings_and_restores(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "extra", 1.0, "y") for i, t in data], "doc_id long, text string, form string, units double, output string").repartition(3)
    made = fim.transform(df)
    assert made.columns[:5] == df.columns and len(set(made.columns)) == 10
    out = made.withColumn("back", fim.restore(made["output_"], made["form_"])).collect()
    got = sorted(((r.doc_id, r.text, r.units_, r["form_"], r.prefix_units, r.middle_units, r["output_"]) for r in out), key=str)
    assert got == sorted(((i, t, *plain(i, t)) for i, t in data), key=str)
    assert all(r.back == (r.text or "") for r in out)
    assert {r["form_"] for r in out} == {"plain", "psm", "spm"}


def test_digests(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = [(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in data]
    assert sorted((tuple(r) for r in fim.digests(fim.transform(df)).collect()), key=str) == sorted(expected, key=str)


def test_words_and_lines_are_never_cut_inside(spark):
    texts = [(i, "some words here\nand a second line\nthird") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for unit, ok in (("word", lambda t, k: k in (0, len(t)) or t[k - 1] in " \n" and t[k] not in " \n" or t[k] in " \n" and t[k - 1] not in " \n"),
                     ("line", lambda t, k: k in (0, len(t)) or t[k - 1] == "\n")):
        made = fim.transform(df, unit=unit, rate=100, spm_rate=0).collect()
        for r in made:
            head = r.output[3 : r.output.index("<S>")]
            assert r.text.startswith(head) and ok(r.text, len(head))
    with pytest.raises(ValueError):
        B.boundaries(np.zeros(1, np.uint8), "page")


def test_empty_table(spark):
    assert fim.digests(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
