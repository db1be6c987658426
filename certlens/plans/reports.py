"""Aggregate reports (G1-G7) as DataFrame -> DataFrame functions.

Conventions
* every report reads the *latest* certificate versions;
* trailing windows are ``Span.trailing(as_of, days)``, ranges ``Span.dates``;
* top-k lists order by count desc then value asc (deterministic ties);
* several single-row aggregates are combined with ``merge_single_rows``
  (a union + max), never with a cartesian join.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlens.config import BREAKDOWN_LABELS
from certlens.functions import certcols
from certlens.functions.timewin import Span, as_date, date_lit
from certlens.operators.latest import latest_updated
from certlens.operators.rollups import DAILY_COUNTERS, FLAG_COUNTERS, _cert_flags

VALIDATION_COUNTS = [("DV", "dv_count"), ("OV", "ov_count"), ("EV", "ev_count"),
                     ("Unknown", "unknown_validation_count")]


def merge_single_rows(*parts: DataFrame) -> DataFrame:
    """Combine one-row DataFrames with disjoint columns into one row."""
    names = [c for p in parts for c in p.columns]
    types = {f.name: f.dataType for p in parts for f in p.schema.fields}
    padded = [p.select(*[F.col(c) if c in p.columns else F.lit(None).cast(types[c]).alias(c) for c in names])
              for p in parts]
    unioned = reduce(lambda a, b: a.unionByName(b), padded)
    return unioned.agg(*[F.max(c).alias(c) for c in names])


def validation_counts(certificates: DataFrame, span: Span) -> DataFrame:
    """DV/OV/EV/Unknown counts over latest certificates last seen in ``span``."""
    vt = certcols.validation_type("policy_oids")
    return (certificates.filter(span.contains("last_seen")).select(vt.alias("vt"))
            .agg(*[F.count(F.when(F.col("vt") == label, 1)).cast("long").alias(name)
                   for label, name in VALIDATION_COUNTS]))


def issuer_stats(daily_stats: DataFrame, certificates: DataFrame, as_of, days: int) -> DataFrame:
    """G1: sums of the daily counters for day >= as_of_date - days, plus
    validation counts over certificates with last_seen >= as_of - days.
    Summed distinct counts double count across days and issuers, as the
    stored rollup does."""
    cutoff = as_date(as_of) - timedelta(days=days)
    stats = latest_updated(daily_stats, ["issuer_key", "day"], ["issuer_key", "day"] + DAILY_COUNTERS)
    sums = stats.filter(F.col("day") >= date_lit(cutoff)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in DAILY_COUNTERS])
    return merge_single_rows(sums, validation_counts(certificates, Span.trailing(as_of, days)))


def issuer_stats_range(observations: DataFrame, certificates: DataFrame, span: Span) -> DataFrame:
    """Exact distinct certificates and domains in the range and distinct
    certificates per flag. Observations are first reduced to distinct
    cert_hash (flags depend on the certificate only), so the flag counts are
    plain sums instead of seven distinct aggregates."""
    obs = span.filter(observations, "seen_at").select("cert_hash", "registered_domain")
    flags = _cert_flags(certificates)
    per_cert = obs.select("cert_hash").distinct().join(flags, "cert_hash")
    cert_part = per_cert.agg(
        F.count("*").cast("long").alias("cert_count"),
        *[F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias(name) for flag, name in FLAG_COUNTERS])
    domain_part = (obs.join(certificates.select("cert_hash"), "cert_hash", "left_semi")
                   .agg(F.count_distinct("registered_domain").cast("long").alias("domain_count")))
    return merge_single_rows(cert_part, domain_part, validation_counts(certificates, span))


def daily_counts(observations: DataFrame, certificates: DataFrame, span: Span,
                 elevated_score: int = 30) -> DataFrame:
    """Per day distinct certificates, distinct domains and distinct
    certificates with anomaly_score >= ``elevated_score``; ordered by day."""
    obs = (span.filter(observations, "seen_at")
           .select(F.to_date("seen_at").alias("day"), "cert_hash", "registered_domain")
           .distinct())
    joined = obs.join(certificates.select("cert_hash", "anomaly_score"), "cert_hash")
    per_cert = (joined.groupBy("day", "cert_hash").agg(F.max("anomaly_score").alias("s"))
                .groupBy("day").agg(F.count("*").cast("long").alias("cert_count"),
                                    F.count(F.when(F.col("s") >= elevated_score, 1)).cast("long")
                                    .alias("elevated_anomaly_count")))
    per_domain = joined.groupBy("day").agg(F.count_distinct("registered_domain").cast("long").alias("domain_count"))
    return (per_cert.join(per_domain, "day")
            .select("day", "cert_count", "domain_count", "elevated_anomaly_count").orderBy("day"))


PROFILE_RATES = [
    ("has_wildcard", "wildcard_rate"), ("has_punycode", "punycode_rate"), ("has_ip_san", "ip_san_rate"),
    ("has_uri_san", "uri_san_rate"), ("has_email_san", "email_san_rate"),
    ("has_must_staple", "must_staple_rate"), ("basic_constraints_ca", "ca_true_rate"),
]


def issuer_profile(certificates: DataFrame, span: Span) -> DataFrame:
    """One-row profile of latest certificates last seen in ``span``.
    Percentiles are exact (linear interpolation)."""
    c = certificates.filter(span.contains("last_seen"))
    return c.agg(
        F.count("*").cast("long").alias("cert_count"),
        F.percentile("validity_days", 0.5).alias("validity_p50"),
        F.percentile("validity_days", 0.95).alias("validity_p95"),
        F.percentile("san_count", 0.5).alias("san_count_p50"),
        F.percentile("san_count", 0.95).alias("san_count_p95"),
        *[F.avg(flag).alias(name) for flag, name in PROFILE_RATES],
    )


def cert_dimension(name: str) -> Column:
    """Certificate-level breakdown / profile dimensions."""
    dims = {
        "issuer_cn": F.col("issuer_cn"),
        "issuer_dn": F.col("issuer_dn"),
        "validation_type": certcols.validation_type("policy_oids"),
        "sig_alg": F.col("sig_alg"),
        "key_type": F.col("key_type"),
        "key_size": F.col("key_size").cast("string"),
        "eku_set": certcols.eku_set("eku"),
        "anomaly_bucket": certcols.anomaly_bucket("anomaly_score"),
        "validity_bucket": certcols.validity_bucket("validity_days"),
        "san_count_bucket": certcols.san_count_bucket("san_count"),
    }
    if name not in dims:
        raise ValueError(f"Unsupported group_by value: {name}")
    return dims[name]


PROFILE_DIMENSIONS = ["sig_alg", "key_type", "key_size", "eku_set", "validation_type"]


def _top(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("count"), F.asc("value")).limit(limit)


def profile_top(certificates: DataFrame, span: Span, dimension: str, limit: int = 5) -> DataFrame:
    """Top values of a profile dimension by certificates (latest versions
    are unique per cert_hash, so a row count is the distinct count)."""
    if dimension not in PROFILE_DIMENSIONS:
        raise ValueError(f"Unsupported profile dimension: {dimension}")
    c = certificates.filter(span.contains("last_seen")).select(cert_dimension(dimension).alias("value"))
    return _top(c.groupBy("value").agg(F.count("*").cast("long").alias("count")), limit)


def breakdown(observations: DataFrame, certificates: DataFrame, findings: DataFrame, group_by: str,
              span: Span, limit: int) -> DataFrame:
    """Top ``limit`` values of one of 13 dimensions.

    * finding_code / severity: distinct certificates per non-empty value of
      findings created in the window (ANOMALY_SCORE included);
    * registered_domain: distinct (cert, domain) pairs of observations;
    * every other dimension: latest certificates last seen in the window.
    """
    if group_by not in BREAKDOWN_LABELS:
        raise ValueError(f"Unsupported group_by value: {group_by}")
    if group_by in ("finding_code", "severity"):
        f = span.filter(findings, "created_at", "created_day").filter(F.col(group_by) != "")
        counts = f.groupBy(F.col(group_by).alias("value")).agg(
            F.count_distinct("cert_hash").cast("long").alias("count"))
    elif group_by == "registered_domain":
        pairs = span.filter(observations, "seen_at").select(
            "cert_hash", F.col("registered_domain").alias("value")).distinct()
        counts = pairs.groupBy("value").agg(F.count("*").cast("long").alias("count"))
    else:
        c = certificates.filter(span.contains("last_seen")).select(cert_dimension(group_by).alias("value"))
        counts = c.groupBy("value").agg(F.count("*").cast("long").alias("count"))
    return _top(counts, limit)


def findings_summary(findings: DataFrame, span: Span, limit: int) -> DataFrame:
    """Distinct certificates per (finding_code, severity), ANOMALY_SCORE
    excluded, by count desc then code (then severity)."""
    f = span.filter(findings, "created_at", "created_day").filter(F.col("finding_code") != "ANOMALY_SCORE")
    return (f.groupBy("finding_code", "severity").agg(F.count_distinct("cert_hash").cast("long").alias("cert_count"))
            .orderBy(F.desc("cert_count"), F.asc("finding_code"), F.asc("severity")).limit(limit))


def severity_totals(findings: DataFrame, span: Span) -> DataFrame:
    """Uncapped distinct certificates per severity (ANOMALY_SCORE excluded)."""
    f = span.filter(findings, "created_at", "created_day").filter(F.col("finding_code") != "ANOMALY_SCORE")
    return (f.groupBy("severity").agg(F.count_distinct("cert_hash").cast("long").alias("cert_count"))
            .orderBy(F.desc("cert_count"), F.asc("severity")))


def multi_breakdown(certificates: DataFrame, span: Span, dims: list[str], limit: int) -> DataFrame:
    """Top ``limit`` values of several certificate dimensions in one pass:
    every certificate row is expanded into (dimension, value) pairs, counted
    in one aggregate (combined map-side) and ranked per dimension.
    Output: (group_by, value, count, rank)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("group_by"), cert_dimension(d).alias("value")) for d in dims])
    c = certificates.filter(span.contains("last_seen")).select(F.explode(pairs).alias("p")).select("p.*")
    counts = c.groupBy("group_by", "value").agg(F.count("*").cast("long").alias("count"))
    w = Window.partitionBy("group_by").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def multi_finding_breakdown(findings: DataFrame, span: Span, limit: int) -> DataFrame:
    """finding_code and severity breakdowns (distinct certificates) in one pass."""
    f = span.filter(findings, "created_at", "created_day")
    pairs = F.array(F.struct(F.lit("finding_code").alias("group_by"), F.col("finding_code").alias("value")),
                    F.struct(F.lit("severity").alias("group_by"), F.col("severity").alias("value")))
    p = f.select("cert_hash", F.explode(pairs).alias("p")).select("cert_hash", "p.*").filter(F.col("value") != "")
    counts = p.groupBy("group_by", "value").agg(F.count_distinct("cert_hash").cast("long").alias("count"))
    w = Window.partitionBy("group_by").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
