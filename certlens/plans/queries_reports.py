"""Registered report queries: rollups, baselines, stats, profiles, breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from certlens import oracle as O
from certlens.catalog import AS_OF, LIMIT, RANGE, ROLLUP_DAYS, STATS_DAYS, TRAILING_DAYS, register
from certlens.config import BREAKDOWN_LABELS
from certlens.functions.timewin import Span
from certlens.operators import baseline as B
from certlens.operators import rollups as R
from certlens.plans import reports as G
from certlens.sources import adapters as A
from certlens.sources import store

_AS = O.AS_OF
_ROLLUP_START = "TIMESTAMP '2024-01-01 00:00:00'"

DAILY_SQL = f"""
SELECT CAST(o.seen_at AS DATE) AS day, o.issuer_key,
       CAST(count(DISTINCT o.cert_hash) AS BIGINT) AS cert_count,
       CAST(count(DISTINCT o.registered_domain) AS BIGINT) AS domain_count,
       CAST(sum(c.has_wildcard) AS BIGINT) AS wildcard_count,
       CAST(sum(c.has_punycode) AS BIGINT) AS punycode_count,
       CAST(sum(c.has_ip_san) AS BIGINT) AS ip_san_count,
       CAST(sum(c.has_uri_san) AS BIGINT) AS uri_san_count,
       CAST(sum(c.has_email_san) AS BIGINT) AS email_san_count,
       CAST(sum({O.UNUSUAL_EKU_SQL}) AS BIGINT) AS unusual_eku_count,
       CAST(sum(c.basic_constraints_ca) AS BIGINT) AS ca_true_leaf_count,
       {_AS} AS updated_at
FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
WHERE o.seen_at >= {_ROLLUP_START}
GROUP BY 1, 2
"""


def _daily(spark, d):
    t = A.tables(spark, d)
    return R.daily_issuer_stats(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)


@register("issuer_daily_rollup", "F5", DAILY_SQL)
def issuer_daily_rollup(spark, d):
    return _daily(spark, d)


@register("issuer_daily_rollup_colocated", "E1", DAILY_SQL)
def issuer_daily_rollup_colocated(spark, d):
    """F5 over tables bucketed by cert_hash: no shuffle below the join."""
    obs, certs = store.bucketed(spark, d)
    return R.daily_issuer_stats(obs, certs, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)


@register("issuer_sigalg_rollup", "F6", f"""
SELECT CAST(o.seen_at AS DATE) AS day, o.issuer_key, c.sig_alg, CAST(count(*) AS BIGINT) AS count,
       {_AS} AS updated_at
FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
WHERE o.seen_at >= {_ROLLUP_START}
GROUP BY 1, 2, 3
""")
def issuer_sigalg_rollup(spark, d):
    t = A.tables(spark, d)
    return R.daily_sigalg_stats(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)


@register("issuer_baseline", "F1", f"""
SELECT o.issuer_key,
       quantile_cont(c.validity_days, 0.5) AS validity_p50,
       quantile_cont(c.validity_days, 0.95) AS validity_p95,
       avg(c.has_wildcard) AS wildcard_rate, avg(c.has_punycode) AS punycode_rate,
       avg(c.has_ip_san) AS ip_san_rate, avg(c.has_uri_san) AS uri_san_rate,
       avg(c.has_email_san) AS email_san_rate
FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
WHERE {O.trailing('o.seen_at', ROLLUP_DAYS)}
GROUP BY 1
""")
def issuer_baseline(spark, d):
    t = A.tables(spark, d)
    return B.issuer_baseline(t.observations, t.certificates, Span.trailing(AS_OF, ROLLUP_DAYS))


@register("issuer_common_eku", "F2", f"""
SELECT issuer_key, eku_key, count, rank FROM (
  SELECT issuer_key, eku_key, count,
         row_number() OVER (PARTITION BY issuer_key ORDER BY count DESC, eku_key ASC) AS rank
  FROM (SELECT o.issuer_key, array_to_string(list_sort(c.eku), ',') AS eku_key, count(*) AS count
        FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
        WHERE {O.trailing('o.seen_at', ROLLUP_DAYS)}
        GROUP BY 1, 2) t) r
WHERE rank <= 5 AND eku_key <> ''
""")
def issuer_common_eku(spark, d):
    t = A.tables(spark, d)
    out = B.issuer_common_eku(t.observations, t.certificates, Span.trailing(AS_OF, ROLLUP_DAYS))
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("issuer_trailing_daily", "F3", f"""
, daily AS ({DAILY_SQL}),
recent AS (
  SELECT issuer_key, day, cert_count,
         row_number() OVER (PARTITION BY issuer_key ORDER BY day DESC) AS rn
  FROM daily WHERE day >= DATE '2024-01-23')
SELECT issuer_key,
       CAST(max(CASE WHEN rn = 1 THEN cert_count END) AS BIGINT) AS current_day_count,
       COALESCE(avg(CASE WHEN rn > 1 THEN cert_count END), 0.0) AS trailing_daily_avg
FROM recent WHERE rn <= 8 GROUP BY 1
""")
def issuer_trailing_daily(spark, d):
    return B.issuer_trailing_daily(_daily(spark, d), AS_OF)


@register("domain_bursts", "F4", f"""
SELECT registered_domain, CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count
FROM observations
WHERE seen_at >= {_AS} - INTERVAL 12 HOUR AND registered_domain <> ''
GROUP BY 1
""")
def domain_bursts(spark, d):
    return B.domain_bursts(A.observations(spark, d), AS_OF, 12)


_VALIDATION_COUNTS = """
SELECT CAST(count(*) FILTER (WHERE vt = 'DV') AS BIGINT) AS dv_count,
       CAST(count(*) FILTER (WHERE vt = 'OV') AS BIGINT) AS ov_count,
       CAST(count(*) FILTER (WHERE vt = 'EV') AS BIGINT) AS ev_count,
       CAST(count(*) FILTER (WHERE vt = 'Unknown') AS BIGINT) AS unknown_validation_count
FROM (SELECT {vt} AS vt FROM certificates WHERE {where}) v
"""


@register("issuer_stats_trailing", "G1", f"""
, daily AS ({DAILY_SQL}),
sums AS (
  SELECT {', '.join(f'CAST(COALESCE(sum({c}), 0) AS BIGINT) AS {c}' for c in R.DAILY_COUNTERS)}
  FROM daily WHERE day >= DATE '2024-01-24'),
vc AS ({_VALIDATION_COUNTS.format(vt=O.VALIDATION_SQL, where=O.trailing('last_seen', STATS_DAYS))})
SELECT * FROM sums, vc
""")
def issuer_stats_trailing(spark, d):
    t = A.tables(spark, d)
    daily = R.daily_issuer_stats(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)
    return G.issuer_stats(daily, t.certificates, AS_OF, STATS_DAYS)


def _flag_distinct(flag_sql: str, name: str) -> str:
    return f"CAST(count(DISTINCT CASE WHEN {flag_sql} THEN o.cert_hash END) AS BIGINT) AS {name}"


@register("issuer_stats_range", "G2", f"""
, agg AS (
  SELECT CAST(count(DISTINCT o.cert_hash) AS BIGINT) AS cert_count,
         CAST(count(DISTINCT o.registered_domain) AS BIGINT) AS domain_count,
         {_flag_distinct('c.has_wildcard = 1', 'wildcard_count')},
         {_flag_distinct('c.has_punycode = 1', 'punycode_count')},
         {_flag_distinct('c.has_ip_san = 1', 'ip_san_count')},
         {_flag_distinct('c.has_uri_san = 1', 'uri_san_count')},
         {_flag_distinct('c.has_email_san = 1', 'email_san_count')},
         {_flag_distinct(O.UNUSUAL_EKU_SQL + ' = 1', 'unusual_eku_count')},
         {_flag_distinct('c.basic_constraints_ca = 1', 'ca_true_leaf_count')}
  FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
  WHERE {O.in_range('o.seen_at', *RANGE)}),
vc AS ({_VALIDATION_COUNTS.format(vt=O.VALIDATION_SQL, where=O.in_range('last_seen', *RANGE))})
SELECT * FROM agg, vc
""")
def issuer_stats_range(spark, d):
    t = A.tables(spark, d)
    return G.issuer_stats_range(t.observations, t.certificates, Span.dates(*RANGE))


@register("daily_counts", "G3", f"""
SELECT CAST(o.seen_at AS DATE) AS day,
       CAST(count(DISTINCT o.cert_hash) AS BIGINT) AS cert_count,
       CAST(count(DISTINCT o.registered_domain) AS BIGINT) AS domain_count,
       CAST(count(DISTINCT CASE WHEN c.anomaly_score >= 30 THEN o.cert_hash END) AS BIGINT) AS elevated_anomaly_count
FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
WHERE {O.in_range('o.seen_at', *RANGE)}
GROUP BY 1
""")
def daily_counts(spark, d):
    t = A.tables(spark, d)
    return G.daily_counts(t.observations, t.certificates, Span.dates(*RANGE))


def _profile_sql(where: str) -> str:
    rates = ", ".join(f"avg({flag}) AS {name}" for flag, name in G.PROFILE_RATES)
    return f"""
SELECT CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count,
       quantile_cont(validity_days, 0.5) AS validity_p50, quantile_cont(validity_days, 0.95) AS validity_p95,
       quantile_cont(san_count, 0.5) AS san_count_p50, quantile_cont(san_count, 0.95) AS san_count_p95,
       {rates}
FROM certificates WHERE {where}
"""


@register("issuer_profile", "G4", _profile_sql(O.trailing("last_seen", ROLLUP_DAYS)))
def issuer_profile(spark, d):
    return G.issuer_profile(A.certificates(spark, d), Span.trailing(AS_OF, ROLLUP_DAYS))


@register("issuer_profile_range", "G4", _profile_sql(O.in_range("last_seen", *RANGE)))
def issuer_profile_range(spark, d):
    return G.issuer_profile(A.certificates(spark, d), Span.dates(*RANGE))


def _top_sql(expr: str, where: str, limit: int, count_expr: str = "count(DISTINCT cert_hash)",
             source: str = "certificates") -> str:
    return f"""
SELECT value, count FROM (
  SELECT {expr} AS value, CAST({count_expr} AS BIGINT) AS count
  FROM {source} WHERE {where} GROUP BY 1) t
ORDER BY count DESC, value ASC LIMIT {limit}
"""


def _profile_top_query(dim: str):
    def run(spark, d):
        return G.profile_top(A.certificates(spark, d), Span.trailing(AS_OF, ROLLUP_DAYS), dim, 5)
    register(f"profile_top_{dim}", "G5", _top_sql(O.DIM_SQL[dim], O.trailing("last_seen", ROLLUP_DAYS), 5))(run)


for _dim in G.PROFILE_DIMENSIONS:
    _profile_top_query(_dim)


def _breakdown_sql(dim: str, where_fn) -> str:
    if dim in ("finding_code", "severity"):
        return _top_sql(dim, f"{where_fn('created_at')} AND {dim} <> ''", LIMIT, source="cert_findings")
    if dim == "registered_domain":
        return f"""
SELECT value, count FROM (
  SELECT value, CAST(count(*) AS BIGINT) AS count
  FROM (SELECT DISTINCT cert_hash, registered_domain AS value FROM observations WHERE {where_fn('seen_at')}) p
  GROUP BY 1) t
ORDER BY count DESC, value ASC LIMIT {LIMIT}
"""
    return _top_sql(O.DIM_SQL[dim], where_fn("last_seen"), LIMIT, count_expr="count(*)")


def _breakdown_query(dim: str, kind: str):
    if kind == "days":
        span = Span.trailing(AS_OF, TRAILING_DAYS)
        sql = _breakdown_sql(dim, lambda c: O.trailing(c, TRAILING_DAYS))
    else:
        span = Span.dates(*RANGE)
        sql = _breakdown_sql(dim, lambda c: O.in_range(c, *RANGE))

    def run(spark, d):
        t = A.tables(spark, d)
        return G.breakdown(t.observations, t.certificates, t.findings, dim, span, LIMIT)
    register(f"breakdown_{dim}_{kind}", "G6", sql)(run)


for _dim in BREAKDOWN_LABELS:
    for _kind in ("days", "range"):
        _breakdown_query(_dim, _kind)


@register("findings_summary", "G7", f"""
SELECT finding_code, severity, CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count
FROM cert_findings
WHERE {O.in_range('created_at', *RANGE)} AND finding_code <> 'ANOMALY_SCORE'
GROUP BY 1, 2
ORDER BY cert_count DESC, finding_code ASC, severity ASC LIMIT {LIMIT}
""")
def findings_summary(spark, d):
    return G.findings_summary(A.cert_findings(spark, d), Span.dates(*RANGE), LIMIT)


@register("severity_totals", "G7", f"""
SELECT severity, CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count
FROM cert_findings
WHERE {O.in_range('created_at', *RANGE)} AND finding_code <> 'ANOMALY_SCORE'
GROUP BY 1
""")
def severity_totals(spark, d):
    return G.severity_totals(A.cert_findings(spark, d), Span.dates(*RANGE))
