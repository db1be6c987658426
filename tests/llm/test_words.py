"""Word scanning and gram hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from certlens.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 \t\n\x0b\x1f\x85é_-語", max_size=40)), max_size=12)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("make, pattern", [(words.white_space_class, r"[^\x20\x09-\x0D]+"), (words.alphanumeric_class, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@given(texts=TEXTS)
@settings(max_examples=150, deadline=None)
def test_scan_matches_the_pattern(make, pattern, texts):
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    h, first, start, end = words.scan(data, offsets, make(), spans=True)
    expected = [re.findall(pattern, lower(t)) for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    raw = data.tobytes()
    assert [lower(raw[a:b].decode()) for a, b in zip(start, end)] == flat
    seen = {}
    for w, x in zip(flat, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_scan_cuts_between_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + " " + "x" * 300 + " end"
    whole = words.scan(*words.buffers(pa.array([text, "", "a b"])), words.white_space_class())
    monkeypatch.setattr(words, "SEGMENT", 64)
    cut = words.scan(*words.buffers(pa.array([text, "", "a b"])), words.white_space_class())
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_buffers_of_slices_and_nulls():
    col = pa.array(["ab", None, "", "cd e"])[1:]
    data, offsets = words.buffers(col)
    assert data.tobytes() == b"cd e" and offsets.tolist() == [0, 0, 0, 4]


def test_grams_differ_by_order_and_length():
    h = words.scan(*words.buffers(pa.array(["a b c b a"])), words.white_space_class())[0]
    two, three = words.grams(h, 2), words.grams(h, 3)
    assert len(set(two.tolist())) == 4 and len(three) == 3 and not set(two.tolist()) & set(three.tolist())
    assert len(words.grams(h, 6)) == 0


def test_chunks_hold_long_rows_alone():
    assert list(words.chunks(np.array([0, 3, 20, 22, 23]), 5)) == [(0, 1), (1, 2), (2, 4)]


def test_scanning_a_megabyte_takes_little_memory():
    import tracemalloc

    text = np.frombuffer(b"some words and more of them " * 40_000, np.uint8)
    words.scan(text[:1000], np.array([0, 1000]), words.white_space_class())
    tracemalloc.start()
    h, _ = words.scan(text, np.array([0, len(text)]), words.white_space_class())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 240_000 and peak < 22e6
