"""Substring search by trigrams (I2): a posting table in place of scans.

Indexed are the lower-cased values of ``subject_cn``, ``issuer_dn``, each ``eku`` and each
finding's code. Three tables, partitioned by field:

* ``search_values`` (value, cert_hash): who has a value, in ranges of the value;
* ``search_grams`` (gram, value): every three letters of a distinct value, in ranges of
  (gram, value), so a gram that most values have is spread over files as well;
* ``search_gram_counts`` (gram, n): in how many values a gram occurs.

A search reads the counts of its needle's grams, takes the rarest of them, intersects
their postings and verifies the values that are left; filters on field and gram reach
the scan, so files and row groups without them are skipped. A needle of fewer than
three letters has no gram; it is compared with the distinct values, which is exact as well.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.functions.timewin import Span
from certlens.plans.search import SearchFilters, search_certificates

GRAM = 3
#: Grams of a needle whose postings are intersected, rarest first.
GRAMS_READ = 3
#: Values and certificates of a search that are pushed to the scans as a list; a larger
#: result is joined instead.
LISTED = 1000
FIELDS = ("subject_cn", "issuer_dn", "eku", "finding_code")
#: Which field each "contains" filter searches.
FILTER_FIELDS = {"subject_cn_contains": "subject_cn", "issuer_contains": "issuer_dn", "eku_contains": "eku", "finding_code_contains": "finding_code"}


def grams(value: Column) -> Column:
    """Distinct trigrams of a string, none if it is shorter."""
    places = F.sequence(F.lit(1), F.greatest(F.length(value) - (GRAM - 1), F.lit(1)))
    every = F.transform(places, lambda i: F.substring(value, i, F.lit(GRAM)))
    return F.when(F.length(value) >= GRAM, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def indexed_values(certificates: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct (field, value, cert_hash); null and empty values have no entry."""
    parts = [certificates.select(F.lit(c).alias("field"), F.lower(c).alias("value"), "cert_hash") for c in ("subject_cn", "issuer_dn")]
    parts.append(certificates.select(F.lit("eku").alias("field"), F.explode("eku").alias("e"), "cert_hash").select("field", F.lower("e").alias("value"), "cert_hash"))
    parts.append(findings.select(F.lit("finding_code").alias("field"), F.lower("finding_code").alias("value"), "cert_hash"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.filter((F.col("value") != "") & F.col("cert_hash").isNotNull()).distinct()


def build_index(certificates: DataFrame, findings: DataFrame, root: str) -> str:
    """Write the three tables below ``root``; returns it."""
    spark = certificates.sparkSession
    (indexed_values(certificates, findings).repartitionByRange("field", "value", "cert_hash").sortWithinPartitions("field", "value", "cert_hash")
     .write.mode("overwrite").partitionBy("field").parquet(f"{root}/search_values"))
    values = spark.read.parquet(f"{root}/search_values").select("field", "value").distinct()
    postings = values.select("field", F.explode(grams(F.col("value"))).alias("gram"), "value")
    (postings.repartitionByRange("field", "gram", "value").sortWithinPartitions("field", "gram", "value")
     .write.mode("overwrite").partitionBy("field").parquet(f"{root}/search_grams"))
    counts = spark.read.parquet(f"{root}/search_grams").groupBy("field", "gram").agg(F.count("*").alias("n"))
    (counts.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram")
     .write.mode("overwrite").partitionBy("field").parquet(f"{root}/search_gram_counts"))
    return root


def _table(spark: SparkSession, root: str, name: str, field: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").filter(F.col("field") == field).drop("field")


def rarest_grams(spark: SparkSession, root: str, field: str, needle: str) -> list[str] | None:
    """The needle's grams to read, rarest first; None if one of them occurs nowhere."""
    own = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    found = {r.gram: r.n for r in _table(spark, root, "search_gram_counts", field).filter(F.col("gram").isin(own)).collect()}
    if len(found) < len(own):
        return None
    return sorted(own, key=lambda g: (found[g], g))[:GRAMS_READ]


def matching_values(spark: SparkSession, root: str, field: str, needle: str) -> DataFrame:
    """(value): the distinct indexed values that contain the needle (lower case)."""
    needle = needle.lower()
    if len(needle) < GRAM:
        return _table(spark, root, "search_values", field).select("value").distinct().filter(F.col("value").contains(needle))
    chosen = rarest_grams(spark, root, field, needle)
    postings = _table(spark, root, "search_grams", field)
    if chosen is None:
        return postings.select("value").limit(0)
    held = postings.filter(F.col("gram").isin(chosen)).groupBy("value").agg(F.count("*").alias("grams"))
    return held.filter((F.col("grams") == len(chosen)) & F.col("value").contains(needle)).select("value")


def _among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose column is among ``keys`` (one column): up to ``LISTED`` of
    them as a list that the scan filters by, else as a join."""
    some = [r[0] for r in keys.limit(LISTED + 1).collect()]
    if len(some) <= LISTED:
        return df.filter(F.col(column).isin(some)) if some else df.limit(0)
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def matching_certificates(spark: SparkSession, root: str, field: str, needle: str) -> DataFrame:
    """(cert_hash): certificates with a value of the field that contains the needle."""
    return _among(_table(spark, root, "search_values", field), "value", matching_values(spark, root, field, needle)).select("cert_hash").distinct()


def search_indexed(root: str, observations: DataFrame, certificates: DataFrame, findings: DataFrame, span: Span, limit: int, filters: SearchFilters) -> DataFrame:
    """I2 with its "contains" filters answered by the index: the same result as
    ``search_certificates``. Both tables are first cut to the certificates found."""
    spark = observations.sparkSession
    active = filters.active()
    hits = None
    for name, field in FILTER_FIELDS.items():
        if name in active:
            found = matching_certificates(spark, root, field, active[name])
            hits = found if hits is None else hits.join(found, "cert_hash", "left_semi")
    rest = replace(filters, **{name: None for name in FILTER_FIELDS})
    if hits is not None:
        certificates, observations = _among(certificates, "cert_hash", hits), _among(observations, "cert_hash", hits)
    return search_certificates(observations, certificates, findings, span, limit, rest)
