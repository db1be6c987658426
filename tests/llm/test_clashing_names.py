"""Stages of the pipeline on tables whose extra columns have the operators' own names."""

from pyspark.sql import functions as F

from certlens.llm import exact_dedup, language_id, mixing, ngram_join, pii

NAMES = ["k", "i", "new", "pii_key", "pii_text", "pii_news", "row_key", "refused_key", "_refused", "_at", "_doc_id", "at", "cls", "root", "jaccard_id", "jaccard_text",
         "digest", "winner", "size", "place", "bucket", "taken", "repetition"]


def test_stages_keep_rows_and_columns(spark):
    text = "the same words of one long enough text for shingles and for the language model "
    rows = [(1, text + "one", "en", "s"), (2, text + "one", "en", "s"), (3, "write to anna.weber@mail.example today", "en", "t"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in NAMES])
    values = lambda df: {tuple(r[n] for n in NAMES) for r in df.collect()}

    replaced = pii.replace_pii(docs)
    assert replaced.columns == docs.columns and values(replaced) == {tuple(NAMES)}
    assert "anna.weber@mail.example" not in {r.text for r in replaced.collect()} and replaced.count() == 4
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns and values(left) == {tuple(NAMES)} and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    known = language_id.keep_identified(docs)
    assert known.columns == docs.columns and values(known) == {tuple(NAMES)} and {1, 2} <= {r.doc_id for r in known.collect()}
    one = exact_dedup.drop_copies(docs)
    assert one.columns == docs.columns and values(one) == {tuple(NAMES)} and sorted(r.doc_id for r in one.collect()) == [1, 3, 4]
    assert set(docs.columns) <= set(mixing.mixture(docs).columns)
