"""Per-issuer baselines (F1-F3) and registered-domain bursts.

Baselines are computed for all issuers at once (one grouped job instead of
one lookup per certificate) and then joined to the certificates being
scored. Their size is one row per issuer key.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlens.functions import certcols
from certlens.functions.timewin import Span, as_date, date_lit
from certlens.operators.latest import latest_updated

RATE_FLAGS = [
    ("has_wildcard", "wildcard_rate"),
    ("has_punycode", "punycode_rate"),
    ("has_ip_san", "ip_san_rate"),
    ("has_uri_san", "uri_san_rate"),
    ("has_email_san", "email_san_rate"),
]


def _weighted_rows(observations: DataFrame, certificates: DataFrame, span: Span, cert_cols) -> DataFrame:
    """Observation rows in the window, collapsed to (issuer_key, cert_hash, n)
    and joined to the certificate columns needed."""
    obs = (span.filter(observations, "seen_at")
           .groupBy("issuer_key", "cert_hash").agg(F.count("*").alias("n")))
    return obs.join(certificates.select("cert_hash", *cert_cols), "cert_hash")


def issuer_baseline(observations: DataFrame, certificates: DataFrame, span: Span) -> DataFrame:
    """exact p50/p95 of validity_days and flag rates, weighted by
    observation rows (a certificate seen 3 times counts 3 times)."""
    rows = _weighted_rows(observations, certificates, span, ["validity_days"] + [f for f, _ in RATE_FLAGS])
    n = F.col("n")
    return rows.groupBy("issuer_key").agg(
        F.percentile(F.col("validity_days"), 0.5, n).alias("validity_p50"),
        F.percentile(F.col("validity_days"), 0.95, n).alias("validity_p95"),
        *[(F.sum(F.col(flag) * n) / F.sum(n)).alias(name) for flag, name in RATE_FLAGS],
    )


def issuer_common_eku(observations: DataFrame, certificates: DataFrame, span: Span, top: int = 5) -> DataFrame:
    """the ``top`` most observed sorted EKU keys per issuer (ties by key);
    the empty key takes a rank but is then dropped."""
    rows = _weighted_rows(observations, certificates, span, [certcols.eku_key("eku").alias("eku_key")])
    counts = rows.groupBy("issuer_key", "eku_key").agg(F.sum("n").alias("count"))
    w = Window.partitionBy("issuer_key").orderBy(F.desc("count"), F.asc("eku_key"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") <= top) & (F.col("eku_key") != "")).select(
        "issuer_key", "eku_key", F.col("count").cast("long").alias("count"), "rank")


def issuer_common_eku_sets(common_eku: DataFrame) -> DataFrame:
    """One row per issuer with the set of common EKU keys (at most ``top``)."""
    return common_eku.groupBy("issuer_key").agg(F.array_sort(F.collect_set("eku_key")).alias("common_eku_sets"))


def issuer_trailing_daily(daily_stats: DataFrame, as_of, lookback_days: int = 8, rows: int = 8) -> DataFrame:
    """newest ``rows`` daily rows with day >= as_of_date - lookback; the
    newest is the current day, the mean of the others the trailing average."""
    cutoff = as_date(as_of) - timedelta(days=lookback_days)
    stats = latest_updated(daily_stats, ["issuer_key", "day"], ["issuer_key", "day", "cert_count"])
    recent = stats.filter(F.col("day") >= date_lit(cutoff))
    w = Window.partitionBy("issuer_key").orderBy(F.desc("day"))
    ranked = recent.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows)
    return ranked.groupBy("issuer_key").agg(
        F.max_by("cert_count", "day").cast("long").alias("current_day_count"),
        F.coalesce(F.avg(F.when(F.col("rn") > 1, F.col("cert_count"))), F.lit(0.0)).alias("trailing_daily_avg"),
    )


def baselines(observations: DataFrame, certificates: DataFrame, daily_stats: DataFrame, as_of,
              days: int) -> DataFrame:
    """All issuer baselines in one row per issuer_key (F1 + F2 + F3)."""
    span = Span.trailing(as_of, days)
    base = issuer_baseline(observations, certificates, span)
    eku = issuer_common_eku_sets(issuer_common_eku(observations, certificates, span))
    spikes = issuer_trailing_daily(daily_stats, as_of)
    return base.join(eku, "issuer_key", "full").join(spikes, "issuer_key", "full")


def domain_bursts(observations: DataFrame, as_of, window_hours: int = 12,
                  domains: DataFrame | None = None) -> DataFrame:
    """distinct certificates per non-empty registered domain seen in the
    last ``window_hours``; optionally restricted to the given domains."""
    obs = (Span.trailing_hours(as_of, window_hours).filter(observations, "seen_at")
           .filter(F.col("registered_domain") != ""))
    if domains is not None:
        obs = obs.join(domains.select("registered_domain").distinct(), "registered_domain", "left_semi")
    return obs.groupBy("registered_domain").agg(F.count_distinct("cert_hash").cast("long").alias("cert_count"))
