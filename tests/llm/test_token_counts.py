"""Token counts against the tokenizer library."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from certlens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.Counter(PATH)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@given(st.text(alphabet=st.one_of(st.sampled_from("ab'stdm 0.9 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　​é語٣½<|>"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_counts_like_the_library(text):
    assert COUNTER.count([text, text + "<|endoftext|> " + text]) == [expected(text), expected(text + "<|endoftext|> " + text)]


def test_query_rows(spark):
    texts = ["Hello world, it's 2024!", None, "", "  two  spaces\n\nlines \n", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endof", "x" * 3000, "word " * 600, "word " * 600, "été　語"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in token_counts.count_tokens(df, PATH).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens_, got[i].n_bytes, got[i].over_limit) == (expected(t), len((t or "").encode()), expected(t) > 512)
        assert got[i].n_tokens == 5


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    own = token_counts.Counter(PATH, ("Hello\0 world", __import__("numpy").array([1, 1])))
    texts = [f"Hello world number{i} q{i}" for i in range(10)]
    assert [own.count([t])[0] for t in texts] == [expected(t) for t in texts]
    assert len(own.cache) < 12


def test_long_texts_go_in_slices(monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 7)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 50)
    own = token_counts.Counter(PATH)
    sizes = []
    whole = own.tokenizer.encode_batch
    own.tokenizer = type("T", (), {"encode_batch": staticmethod(lambda x, **k: sizes.append(len(x)) or whole(x, **k))})
    texts = [" ".join(f"word{i} it's {i}" for i in range(200)), "x" * 400, "a<|endoftext|>" * 30 + "  \n\n  b", "short", ""]
    assert own.count(texts) == [expected(t) for t in texts]
    assert max(sizes) <= 7 and not any(len(p) > token_counts.CACHED for p in own.cache)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.length("text") < 4000)
    got = token_counts.count_tokens(docs.select("text"), PATH).collect()
    assert all(r.n_tokens == expected(r.text) for r in got) and got
