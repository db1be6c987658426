"""Corpus pipeline: five stages of the numbered operators over ``documents``.

1. language ID: documents whose language is not accepted go (no letters, or no
   language with a posterior of one half);
2. n-gram Jaccard join: of every group of near-duplicates (five-word shingles,
   similarity 0.8 or more) the document with the smallest id stays;
3. benchmark decontamination: documents that the rule calls contaminated go;
4. PII: entities get surrogates;
5. mixing: documents repeat, or are left out, as their source's target asks.

Stages 1 to 4 return the columns of ``documents``; the last adds repetition and
taken (words). Every stage takes its predecessor's rows, whatever their number.
Nulls in any column, empty texts, repeated rows, extra columns and empty tables
are handled as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from certlens.llm import decontaminate, language_id, mixing, ngram_join, pii
from certlens.llm.shared import keep, table
from certlens.session import ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, length="n_chars")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the language model, nor the surrogates' keyed draws; the
#: stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
