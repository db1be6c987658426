"""Registered queries over stored sketches (F1, F5, G1-G4): the exact value from the
tables, and whether what the sketches alone say lies within their bound."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from certlens import oracle as O
from certlens.catalog import AS_OF, RANGE, ROLLUP_DAYS, register
from certlens.functions.timewin import Span
from certlens.operators import rollups as R
from certlens.operators import sketches as Sk
from certlens.plans import reports as G
from certlens.session import shared_path
from certlens.sources import adapters as A

_SEEN = f"seen_at >= date_trunc('day', {O.AS_OF} - INTERVAL {ROLLUP_DAYS} DAY)"
_UNUSUAL = O.UNUSUAL_EKU_SQL
_FLAGS = {"has_wildcard": "wildcard_count", "has_punycode": "punycode_count", "has_ip_san": "ip_san_count", "has_uri_san": "uri_san_count",
          "has_email_san": "email_san_count", "unusual_eku": "unusual_eku_count", "basic_constraints_ca": "ca_true_leaf_count"}


def _stored(spark, d) -> tuple[A.CertTables, str]:
    """The given tables, and the folder of their sketches, written day by day."""
    t = A.tables(spark, d)
    path = shared_path(spark, f"sketches-{uuid.uuid4().hex}")
    Sk.write_sketches(Sk.daily_sketches(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS)), path)
    return t, path


@register("sketch_daily_counts", "G3", f"""
SELECT CAST(seen_at AS DATE) AS day, CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count,
       CAST(count(DISTINCT o.registered_domain) AS BIGINT) AS domain_count,
       CAST(count(DISTINCT CASE WHEN anomaly_score >= 30 THEN cert_hash END) AS BIGINT) AS elevated_anomaly_count,
       TRUE AS in_bound
FROM observations o JOIN certificates c USING (cert_hash) WHERE {O.in_range('seen_at', *RANGE)} GROUP BY 1
""")
def sketch_daily_counts(spark, d):
    t, path = _stored(spark, d)
    exact = G.daily_counts(t.observations, t.certificates, Span.dates(*RANGE))
    told = Sk.distinct_counts(Sk.read_sketches(spark, path, *RANGE), ["day"], ["certs", "domains", "elevated"])
    ok = (Sk.count_in_bound(F.col("certs"), F.col("cert_count")) & Sk.count_in_bound(F.col("domains"), F.col("domain_count"))
          & Sk.count_in_bound(F.col("elevated"), F.col("elevated_anomaly_count")))
    return exact.join(told, "day").select("day", "cert_count", "domain_count", "elevated_anomaly_count", ok.alias("in_bound"))


def _flag_sql(flag: str, name: str) -> str:
    value = _UNUSUAL if flag == "unusual_eku" else flag
    return f"CAST(count(DISTINCT CASE WHEN {value} = 1 THEN cert_hash END) AS BIGINT) AS {name}"


@register("sketch_window_counts", "G2", f"""
SELECT CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count, CAST(count(DISTINCT o.registered_domain) AS BIGINT) AS domain_count,
       {', '.join(_flag_sql(f, n) for f, n in _FLAGS.items())}, TRUE AS in_bound
FROM observations o JOIN certificates c USING (cert_hash) WHERE {O.in_range('seen_at', *RANGE)}
""")
def sketch_window_counts(spark, d):
    t, path = _stored(spark, d)
    exact = G.issuer_stats_range(t.observations, t.certificates, Span.dates(*RANGE))
    names = {"certs": "cert_count", "domains": "domain_count", **_FLAGS}
    told = Sk.distinct_counts(Sk.read_sketches(spark, path, *RANGE))
    both = G.merge_single_rows(exact.select(*names.values()), told.select(*names))
    ok = F.lit(True)
    for sketch, column in names.items():
        ok = ok & Sk.count_in_bound(F.col(sketch), F.col(column))
    return both.select(*names.values(), ok.alias("in_bound"))


@register("sketch_new_certificates", "F5", f"""
, seen AS (SELECT o.issuer_key, cert_hash, max(seen_at) AS newest, min(seen_at) AS oldest
           FROM observations o JOIN certificates c USING (cert_hash) WHERE {_SEEN} GROUP BY 1, 2)
SELECT issuer_key, CAST(count(*) FILTER (newest >= DATE '{RANGE[1]}') AS BIGINT) AS cert_count,
       CAST(count(*) FILTER (oldest >= DATE '{RANGE[1]}') AS BIGINT) AS new_cert_count, TRUE AS in_bound
FROM seen GROUP BY issuer_key
""")
def sketch_new_certificates(spark, d):
    t, path = _stored(spark, d)
    obs = R.refresh_span(AS_OF, ROLLUP_DAYS).filter(t.observations, "seen_at").join(t.certificates.select("cert_hash"), "cert_hash", "left_semi")
    seen = obs.groupBy("issuer_key", "cert_hash").agg(F.max("seen_at").alias("newest"), F.min("seen_at").alias("oldest"))
    since = F.lit(RANGE[1]).cast("timestamp_ntz")
    exact = seen.groupBy("issuer_key").agg(F.count(F.when(F.col("newest") >= since, 1)).alias("cert_count"),
                                           F.count(F.when(F.col("oldest") >= since, 1)).alias("new_cert_count"))
    told = Sk.new_certificates(Sk.read_sketches(spark, path), RANGE[1])
    # a difference is as uncertain as the set it is taken from
    near = F.abs(F.col("new_certs") - F.col("new_cert_count")) <= F.lit(2 * Sk.COUNT_ERROR) * F.col("cert_count")
    ok = Sk.count_in_bound(F.col("certs"), F.col("cert_count")) & near
    return exact.join(told, "issuer_key").select("issuer_key", "cert_count", "new_cert_count", ok.alias("in_bound"))


def _quantile_sql(column: str) -> str:
    ranks = " UNION ALL ".join(
        f"SELECT issuer_key, '{column}' AS measure, CAST({r} AS DOUBLE) AS rank, quantile_cont({column}, {r}) AS value, TRUE AS in_bound FROM row_values GROUP BY 1"
        for r in (0.5, 0.95))
    return ranks


@register("sketch_quantiles", "F1", f"""
, row_values AS (SELECT o.issuer_key, validity_days, san_count FROM observations o JOIN certificates c USING (cert_hash) WHERE {_SEEN})
{_quantile_sql('validity_days')} UNION ALL {_quantile_sql('san_count')}
""")
def sketch_quantiles(spark, d):
    """The exact quantile of each issuer's observation rows; in_bound: the rank of the
    sketches' value among those rows is within the rank error."""
    t, path = _stored(spark, d)
    obs = R.refresh_span(AS_OF, ROLLUP_DAYS).filter(t.observations, "seen_at").groupBy("issuer_key", "cert_hash").agg(F.count("*").alias("n"))
    rows = obs.join(t.certificates.select("cert_hash", *Sk.QUANTILE_COLUMNS), "cert_hash")
    out = None
    for column in Sk.QUANTILE_COLUMNS:
        told = Sk.quantiles(Sk.read_sketches(spark, path), ["issuer_key"], column)
        counted = rows.groupBy("issuer_key", F.col(column).alias("x")).agg(F.sum("n").alias("n"))
        exact = counted.groupBy("issuer_key").agg(F.percentile("x", 0.5, F.col("n")).alias("p50"), F.percentile("x", 0.95, F.col("n")).alias("p95"), F.sum("n").alias("rows"))
        # share of rows below the told value, and up to it
        place = counted.join(told, "issuer_key").groupBy("issuer_key", "rank", "value").agg(
            F.sum(F.when(F.col("x") < F.col("value"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("n")).otherwise(0)).alias("up_to"))
        ok = ((F.col("below") / F.col("rows") <= F.col("rank") + Sk.RANK_ERROR) & (F.col("up_to") / F.col("rows") >= F.col("rank") - Sk.RANK_ERROR))
        part = place.join(exact, "issuer_key").select("issuer_key", F.lit(column).alias("measure"), "rank",
                                                      F.when(F.col("rank") == 0.5, F.col("p50")).otherwise(F.col("p95")).alias("value"), ok.alias("in_bound"))
        out = part if out is None else out.unionByName(part)
    return out
