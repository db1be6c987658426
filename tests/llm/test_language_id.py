"""Language ID: accuracy, and what each kind of evidence does."""

import numpy as np
from pyspark.sql import functions as F

from certlens.llm import language_id as L


def model_of(spark):
    return L.fit_text_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def identify(spark, rows, model):
    df = spark.createDataFrame(rows, "id int, text string, declared string, host string, grams string").repartition(3)
    return {r.id: r for r in L.identify(df, model).collect()}


def test_accuracy_on_other_documents(spark):
    tags, _ = model = model_of(spark)
    assert tags == ["de", "en", "es", "fr"]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 1000 and doc_id < 4000")
    got = L.identify(docs.select("doc_id", "lang", "text", F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host")), model).select(
        "doc_id", "lang", "lang_", "text_lang", "accepted").collect()
    assert np.mean([r.lang == r.text_lang for r in got]) > 0.97 and np.mean([r.lang == r.lang_ for r in got]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.99


def test_evidence_decides_where_the_text_does_not(spark):
    model = model_of(spark)
    long = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 400").collect()}
    rows = [(i, long["fr"], "fr", "a.site.fr", "x") for i in range(40)] + [(i + 100, long["de"], "de", "b.site.example", "x") for i in range(40)]
    rows += [(200, "zq", None, "a.site.fr", "x"), (201, "zq", None, "www.b.site.example:80", "x"), (202, "zq", "es-MX", "q.other.xyz", "x"), (203, "zq", None, "neu.de", "x"), (204, "zq", None, "nouveau.fr", "x")]
    got = identify(spark, rows, model)
    assert [got[i].lang for i in (200, 201, 203, 204)] == ["fr", "de", "de", "fr"]
    assert got[202].suffix == "xyz" and got[0].grams == "x" and got[0].grams_ > 0
    assert all(got[i].lang == "fr" and got[i].accepted for i in range(40))


def test_nulls_no_letters_and_repeated_rows(spark):
    model = model_of(spark)
    rows = [(1, None, None, None, None), (2, "", "en", "h", None), (3, "123 456 !!", "fr", "h", None), (4, "the of and that is " * 50_000, "not a tag", None, None), (4, "the of and that is " * 50_000, "not a tag", None, None)]
    got = identify(spark, rows, model)
    assert [got[i].accepted for i in (1, 2, 3, 4)] == [False, False, False, True] and got[4].lang == "en"
    assert got[1].grams_ == 0 and got[1].text_lang is None
    assert identify(spark, [], model) == {}


def test_no_labels(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = L.fit_text_model(empty)
    assert model[0] == ["und"]
    assert [(r.lang, r.accepted) for r in identify(spark, [(1, "some text", "en", "h", None)], model).values()] == [("und", False)]


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123", None, None, None), (None, "the of and to in is that", None, None, 5), (None, "the of and to in is that", None, None, 5)], docs.schema)
    both = docs.unionByName(odd).withColumn("row_key", F.lit(1))
    kept = L.keep_identified(both)
    assert kept.columns == both.columns
    assert kept.count() == docs.count() + 2
    assert L.keep_identified(both.limit(0)).count() == 0


def test_grams_stay_inside_rows():
    from certlens.llm import words
    import pyarrow as pa

    bins, at = L._bins(*words.buffers(pa.array(["abcd", None, "ab", "cdef gh", "  ", "1a--2bc3"])))
    assert np.diff(at).tolist() == [1, 0, 0, 4, 0, 3]
    one, _ = L._bins(*words.buffers(pa.array(["ABCD"])))
    assert one[0] == bins[0]


def test_noise_and_languages_without_labels_are_refused(spark):
    import random

    rng = random.Random(4)
    noise = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(40))
    polish = "Szczęście jest wtedy gdy wszystko się układa tak jak chcemy i nic nam nie przeszkadza w codziennym życiu"
    russian = "Привет мир, сегодня хорошая погода и мы идем гулять в парк с друзьями"
    plain = {"de": "die und der ist nicht ein den mit das", "en": "the weather and what is there with the other people of this",
             "es": "el que los para una como pero más", "fr": "les que pour une dans est pas avec"}
    rows = [(1, noise, None, None, "x"), (2, polish, None, "h.pl", "x"), (3, russian, None, None, "x"), (4, noise * 500, "en", "h.uk", "x")]
    rows += [(10 + i, t, k, None, "x") for i, (k, t) in enumerate(plain.items())] + [(20, "zq zq", None, None, "x")]
    got = identify(spark, rows, model_of(spark))
    assert [got[i].accepted for i in (1, 2, 3, 4)] == [False] * 4
    assert [(got[10 + i].lang, got[10 + i].accepted) for i in range(4)] == [(k, True) for k in plain]


def test_clean_documents_are_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 60")
    got = L.identify(docs.select("text", F.col("lang").alias("declared"), F.col("source").alias("host")), model_of(spark))
    assert got.filter("not accepted").count() == 0
