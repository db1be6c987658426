"""The pipeline's stages against brute force over their own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from certlens.llm.shared import keep
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_mixing import plain_targets
from tests.llm.test_ngram_join import brute as near_duplicates

SMOKE = "/root/testdata/sf0.001"
PRIVATE = [r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<!\d)\d{16}(?!\d)", r"AKIA[0-9A-Z]{16}",
           r"(?<=token = \")[0-9a-f]+", r"(?<=password=)\w+"]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output rows; odd rows are added to documents."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    odd = [(9001, None, "en", "src1", 0), (9002, "", None, None, None), (9003, "12 34", "en", "src1", 5), (None, "the and of to in is that it was", None, None, 31),
           (9004, docs.filter("n_chars > 300").orderBy("doc_id").first().text, "en", "src2", 1), (9005, "mail a.b@c.org now and then to the man", "en", "src3", 20)]
    rows = keep(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "test-docs")
    out = [rows]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], SMOKE), "test-stage"))
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "mixing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert stages[5].columns == [*stages[0].columns, "repetition", "taken"]


def test_language_stage_drops_rows_without_letters_only(stages):
    gone = set(pairs(stages[0])) - set(pairs(stages[1]))
    assert gone == {(d, t) for d, t in pairs(stages[0]) if not re.search(r"[^\W\d_]", t or "")}


def test_one_document_of_each_group_stays(stages):
    rows = pairs(stages[1])
    component = {}
    for (doc, n, comp) in near_duplicates(rows):
        component.setdefault(comp, []).append(doc)
    kept = [d for d, _ in pairs(stages[2])]
    assert sorted(kept, key=str) == sorted(component, key=str)


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").select("item_id", "text").collect()]
    rows = pairs(stages[2])
    clean = sorted((r[0] for r in contamination(rows, items) if not r[4]), key=str)
    assert [d for d, _ in pairs(stages[3])] == clean and len(clean) < len(rows)


def test_nothing_private_is_left_and_other_text_stays(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert before.keys() == after.keys()
    real = {m for t in before.values() for p in PRIVATE for m in re.findall(p, t)}
    assert len(real) > 5 and not [m for t in after.values() for p in PRIVATE for m in re.findall(p, t) if m in real]
    for d, t in before.items():
        blank = lambda x: re.sub("|".join(PRIVATE), "#", x)
        assert blank(t) == blank(after[d])
    changed = stages[4].filter("n_chars <> length(text)").select("doc_id").collect()
    assert all(before[r.doc_id] == after[r.doc_id] for r in changed)


def test_mixture_meets_its_targets(stages):
    sizes = {r.source: r.n for r in stages[4].groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))).alias("n")).collect()}
    taken = {r.source: r.n for r in stages[5].groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    target = plain_targets(sizes)
    assert taken == {s: int(t + 0.5) for s, t in target.items() if int(t + 0.5)}
    assert stages[5].groupBy("doc_id", "source").agg(F.max("repetition").alias("n")).filter("n > 3").isEmpty()


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SMOKE), "test-empty")
        assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMOKE).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
