"""Daily issuer rollups (F5, F6) and their refresh cutoff (part of F7).

Observation rows are first collapsed per (day, issuer, cert[, domain]) with a
map-side-combined count, so the join to ``certificates`` and the final
aggregates work on pre-aggregated rows. Flag sums stay weighted by the
number of observation rows, as in the original rollup.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.functions import certcols
from certlens.functions.timewin import Span, as_datetime, ts_lit

FLAG_COUNTERS = [
    ("has_wildcard", "wildcard_count"),
    ("has_punycode", "punycode_count"),
    ("has_ip_san", "ip_san_count"),
    ("has_uri_san", "uri_san_count"),
    ("has_email_san", "email_san_count"),
    ("unusual_eku", "unusual_eku_count"),
    ("basic_constraints_ca", "ca_true_leaf_count"),
]
DAILY_COUNTERS = ["cert_count", "domain_count"] + [name for _, name in FLAG_COUNTERS]


def refresh_span(as_of, days: int, align: str = "day") -> Span:
    """Cutoff of a rollup refresh: ``as_of - max(days, 1)`` days.

    ``align="day"`` moves the cutoff to the start of its day so the oldest
    day is never cut in half; ``align="exact"`` keeps the timestamp.
    """
    start = as_datetime(as_of) - timedelta(days=max(days, 1))
    if align == "day":
        start = start.replace(hour=0, minute=0, second=0, microsecond=0)
    return Span(start, None)


def _cert_flags(certificates: DataFrame) -> DataFrame:
    return certificates.select(
        "cert_hash", "has_wildcard", "has_punycode", "has_ip_san", "has_uri_san", "has_email_san",
        certcols.unusual_eku("eku").cast("int").alias("unusual_eku"), "basic_constraints_ca")


def daily_issuer_stats(observations: DataFrame, certificates: DataFrame, span: Span,
                       updated_at=None) -> DataFrame:
    """per (day, issuer_key) exact distinct certs and domains, flag sums
    over observation rows joined to the latest certificate.

    One joined frame: every row counts under its certificate and under its
    domain, distinct values collapse in a first grouping that has the value as a
    key (so a large issuer's day is spread out), the second only adds up."""
    obs = (span.filter(observations, "seen_at")
           .select(F.to_date("seen_at").alias("day"), "issuer_key", "cert_hash", "registered_domain")
           .groupBy("day", "issuer_key", "cert_hash", "registered_domain").agg(F.count("*").alias("n")))
    joined = obs.join(_cert_flags(certificates), "cert_hash")
    value = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
    flags = [F.sum(F.when(F.col("of.kind") == "cert", F.col("n") * F.col(flag))).alias(name) for flag, name in FLAG_COUNTERS]
    values = (joined.withColumn("of", F.explode(F.array(value("cert", "cert_hash"), value("domain", "registered_domain"))))
              .groupBy("day", "issuer_key", "of").agg(*flags))
    distinct = lambda kind: F.count(F.when(F.col("of.kind") == kind, F.col("of.value")))
    out = values.groupBy("day", "issuer_key").agg(
        distinct("cert").alias("cert_count"), distinct("domain").alias("domain_count"), *[F.sum(name).alias(name) for _, name in FLAG_COUNTERS])
    stamp = ts_lit(updated_at) if updated_at is not None else F.current_timestamp()
    return out.select("day", "issuer_key", *[F.col(c).cast("long").alias(c) for c in DAILY_COUNTERS],
                      stamp.alias("updated_at"))


def daily_sigalg_stats(observations: DataFrame, certificates: DataFrame, span: Span,
                       updated_at=None) -> DataFrame:
    """observation rows per (day, issuer_key, sig_alg)."""
    obs = (span.filter(observations, "seen_at")
           .select(F.to_date("seen_at").alias("day"), "issuer_key", "cert_hash")
           .groupBy("day", "issuer_key", "cert_hash").agg(F.count("*").alias("n")))
    joined = obs.join(certificates.select("cert_hash", "sig_alg"), "cert_hash")
    stamp = ts_lit(updated_at) if updated_at is not None else F.current_timestamp()
    return (joined.groupBy("day", "issuer_key", "sig_alg").agg(F.sum("n").cast("long").alias("count"))
            .select("day", "issuer_key", "sig_alg", "count", stamp.alias("updated_at")))


def daily_cert_counts(observations: DataFrame, certificates: DataFrame, span: Span, updated_at=None) -> DataFrame:
    """The ``cert_count`` column of F5 alone (what the trailing-daily
    baseline reads): distinct joined certificates per (day, issuer_key)."""
    obs = (span.filter(observations, "seen_at")
           .select(F.to_date("seen_at").alias("day"), "issuer_key", "cert_hash").distinct())
    joined = obs.join(certificates.select("cert_hash"), "cert_hash", "left_semi")
    stamp = ts_lit(updated_at) if updated_at is not None else F.current_timestamp()
    return (joined.groupBy("day", "issuer_key").agg(F.count("*").cast("long").alias("cert_count"))
            .withColumn("updated_at", stamp))
