"""Registered ranking, lookup and search queries (G8/H, I1-I3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from certlens import oracle as O
from certlens.catalog import AS_OF, LIMIT, RANGE, ROLLUP_DAYS, TRAILING_DAYS, register
from certlens.functions.timewin import Span
from certlens.operators import rollups as R
from certlens.operators.rollups import DAILY_COUNTERS
from certlens.plans import anomalies as H
from certlens.plans import reports as G
from certlens.plans import search as I
from certlens.plans import search_index as Tg
from certlens.plans.queries_reports import DAILY_SQL
from certlens.sources import adapters as A
from certlens.sources import store

DETAIL_CERT = "cert-42"
ACTIVITY_DOMAIN = "site7.example"
SEARCH_LIMIT = 20


def _win(kind: str):
    if kind == "days":
        return lambda c: O.trailing(c, TRAILING_DAYS)
    return lambda c: O.in_range(c, *RANGE)


def _span(kind: str) -> Span:
    return Span.trailing(AS_OF, TRAILING_DAYS) if kind == "days" else Span.dates(*RANGE)


def _top_anomalies_sql(win, by_cert: bool = False) -> str:
    if by_cert:
        top = f"""
top AS (
  SELECT cert_hash, subject_cn, dns_names, CAST(anomaly_score AS BIGINT) AS anomaly_score, last_seen,
         CAST(NULL AS VARCHAR) AS rank_ev
  FROM certificates WHERE {win('last_seen')} AND anomaly_score > 0
  ORDER BY anomaly_score DESC, last_seen DESC, cert_hash ASC LIMIT {LIMIT})"""
    else:
        top = f"""
anomaly AS (
  SELECT cert_hash, evidence_json,
         row_number() OVER (PARTITION BY cert_hash ORDER BY created_at DESC) AS rn
  FROM cert_findings WHERE finding_code = 'ANOMALY_SCORE' AND {win('created_at')}),
top AS (
  SELECT c.cert_hash, c.subject_cn, c.dns_names,
         CAST(json_extract_string(a.evidence_json, '$.anomaly_score') AS BIGINT) AS anomaly_score,
         c.last_seen, a.evidence_json AS rank_ev
  FROM anomaly a JOIN certificates c ON c.cert_hash = a.cert_hash
  WHERE a.rn = 1 AND {win('c.last_seen')}
    AND CAST(json_extract_string(a.evidence_json, '$.anomaly_score') AS BIGINT) > 0
  ORDER BY anomaly_score DESC, c.last_seen DESC, c.cert_hash ASC LIMIT {LIMIT})"""
    return f""", {top},
latest_ev AS (
  SELECT cert_hash, evidence_json FROM (
    SELECT cert_hash, evidence_json,
           row_number() OVER (PARTITION BY cert_hash ORDER BY created_at DESC) AS rn
    FROM cert_findings
    WHERE finding_code = 'ANOMALY_SCORE' AND cert_hash IN (SELECT cert_hash FROM top)) x
  WHERE rn = 1),
sev AS (
  SELECT cert_hash,
         '{{' || string_agg('"' || severity || '":' || CAST(cnt AS VARCHAR), ',' ORDER BY severity) || '}}'
           AS finding_severity_counts
  FROM (SELECT cert_hash, severity, count(*) AS cnt FROM cert_findings
        WHERE {win('created_at')} AND finding_code <> 'ANOMALY_SCORE'
          AND cert_hash IN (SELECT cert_hash FROM top)
        GROUP BY 1, 2) s
  GROUP BY 1)
SELECT t.cert_hash, t.subject_cn, t.dns_names[1:5] AS dns_names, t.anomaly_score, t.last_seen,
       COALESCE(l.evidence_json, t.rank_ev, '{{"top_signals": []}}') AS evidence_json,
       COALESCE(s.finding_severity_counts, '{{}}') AS finding_severity_counts,
       COALESCE(CAST(json_extract(COALESCE(l.evidence_json, t.rank_ev, '{{"top_signals": []}}'), '$.top_signals')
                     AS VARCHAR), '[]') AS top_signals_json,
       t.dns_names[1:5] AS dns_names_unicode
FROM top t LEFT JOIN latest_ev l ON l.cert_hash = t.cert_hash LEFT JOIN sev s ON s.cert_hash = t.cert_hash
"""


def _anomaly_query(kind: str, by_cert: bool = False):
    name = "top_anomalies_by_cert_score" if by_cert else f"top_anomalies_{kind}"

    def run(spark, d):
        t = A.tables(spark, d)
        return H.top_anomalies(t.findings, t.certificates, _span(kind), LIMIT,
                               score_source="certificate" if by_cert else "finding")
    register(name, "G8", _top_anomalies_sql(_win(kind), by_cert))(run)


_anomaly_query("days")
_anomaly_query("range")
_anomaly_query("days", by_cert=True)


_SUMS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in DAILY_COUNTERS)
_KINDS_SQL = ", ".join(f"CAST(count(*) FILTER (vt = '{label}') AS BIGINT) AS {name}" for label, name in G.VALIDATION_COUNTS)


@register("anomalies_report", "N", f"""
, rolled AS ({DAILY_SQL}),
sums AS (SELECT {_SUMS_SQL} FROM rolled WHERE day >= CAST({O.AS_OF} AS DATE) - INTERVAL {TRAILING_DAYS} DAY),
kinds AS (SELECT {_KINDS_SQL} FROM (SELECT {O.VALIDATION_SQL} AS vt FROM certificates WHERE {O.trailing('last_seen', TRAILING_DAYS)}) x),
scored AS (SELECT cert_hash, CAST(json_extract_string(arg_max(evidence_json, created_at), '$.anomaly_score') AS BIGINT) AS anomaly_score
           FROM cert_findings WHERE finding_code = 'ANOMALY_SCORE' AND {O.trailing('created_at', TRAILING_DAYS)} GROUP BY 1),
best AS (SELECT cert_hash, subject_cn, scored.anomaly_score, row_number() OVER (ORDER BY scored.anomaly_score DESC, last_seen DESC, cert_hash) AS position
         FROM scored JOIN certificates USING (cert_hash) WHERE scored.anomaly_score > 0 AND {O.trailing('last_seen', TRAILING_DAYS)} QUALIFY position <= {LIMIT}),
severities AS (SELECT cert_hash, severity, count(*) AS n FROM cert_findings
               WHERE finding_code <> 'ANOMALY_SCORE' AND {O.trailing('created_at', TRAILING_DAYS)} GROUP BY 1, 2),
listed AS (SELECT cert_hash, chr(123) || string_agg('"' || severity || '":' || CAST(n AS VARCHAR), ',' ORDER BY severity) || chr(125) AS told FROM severities GROUP BY 1)
SELECT CAST(position AS INTEGER) AS position, best.cert_hash, subject_cn, anomaly_score, coalesce(told, chr(123) || chr(125)) AS finding_severity_counts, sums.*, kinds.*
FROM best LEFT JOIN listed USING (cert_hash), sums, kinds
""")
def anomalies_report(spark, d):
    t = A.tables(spark, d)
    daily = R.daily_issuer_stats(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)
    stats = G.issuer_stats(daily, t.certificates, AS_OF, TRAILING_DAYS)
    return H.report_rows(H.anomalies_report(stats, t.findings, t.certificates, Span.trailing(AS_OF, TRAILING_DAYS), LIMIT))


@register("anomaly_severity_counts", "H5", f"""
, anomaly AS (
  SELECT cert_hash, evidence_json,
         row_number() OVER (PARTITION BY cert_hash ORDER BY created_at DESC) AS rn
  FROM cert_findings WHERE finding_code = 'ANOMALY_SCORE' AND {O.trailing('created_at', TRAILING_DAYS)}),
top AS (
  SELECT c.cert_hash FROM anomaly a JOIN certificates c ON c.cert_hash = a.cert_hash
  WHERE a.rn = 1 AND {O.trailing('c.last_seen', TRAILING_DAYS)}
    AND CAST(json_extract_string(a.evidence_json, '$.anomaly_score') AS BIGINT) > 0
  ORDER BY CAST(json_extract_string(a.evidence_json, '$.anomaly_score') AS BIGINT) DESC, c.last_seen DESC,
           c.cert_hash ASC
  LIMIT {LIMIT})
SELECT cert_hash, severity, count(*) AS count FROM cert_findings
WHERE {O.trailing('created_at', TRAILING_DAYS)} AND finding_code <> 'ANOMALY_SCORE'
  AND cert_hash IN (SELECT cert_hash FROM top)
GROUP BY 1, 2
""")
def anomaly_severity_counts(spark, d):
    t = A.tables(spark, d)
    span = Span.trailing(AS_OF, TRAILING_DAYS)
    top = H.rank_anomalies(t.findings, t.certificates, span, LIMIT)
    return H.severity_counts(t.findings, F.broadcast(top.select("cert_hash")), span)


_DETAIL_COLS = ["cert_hash", "subject_cn", "issuer_cn", "issuer_dn", "dns_names", "san_count", "validity_days",
                "key_type", "key_size", "sig_alg", "eku", "policy_oids", "has_wildcard", "has_punycode",
                "anomaly_score", "last_seen"]


@register("certificate_detail", "I1", f"""
SELECT {', '.join(_DETAIL_COLS)}, {O.VALIDATION_SQL} AS validation_type, dns_names AS dns_names_unicode
FROM certificates WHERE cert_hash = '{DETAIL_CERT}'
""")
def certificate_detail(spark, d):
    c = A.certificates(spark, d, columns=_DETAIL_COLS[1:])
    return I.certificate_detail(c, DETAIL_CERT)


@register("certificate_findings", "I1", f"""
SELECT finding_code, severity, evidence_json, created_at FROM cert_findings
WHERE cert_hash = '{DETAIL_CERT}'
ORDER BY created_at DESC, finding_code, severity, evidence_json LIMIT 100
""")
def certificate_findings(spark, d):
    return I.certificate_findings(A.cert_findings(spark, d), DETAIL_CERT, 100)


SEARCHES = {
    "search_registered_domain": (I.SearchFilters(registered_domain="site7.example"),
                                 "o.registered_domain = 'site7.example'"),
    "search_validation_type": (I.SearchFilters(validation_type="OV"), f"{O.VALIDATION_SQL} = 'OV'"),
    "search_subject_cn": (I.SearchFilters(subject_cn_contains="customer#00000004"),
                          "position('customer#00000004' IN lower(c.subject_cn)) > 0"),
    "search_issuer": (I.SearchFilters(issuer_contains="build"), "position('build' IN lower(c.issuer_dn)) > 0"),
    "search_eku": (I.SearchFilters(eku_contains="CLIENT"),
                   "len(list_filter(c.eku, lambda e: position('client' IN lower(e)) > 0)) > 0"),
    "search_finding_code": (I.SearchFilters(finding_code="SAN_MISSING"),
                            "c.cert_hash IN (SELECT cert_hash FROM cert_findings WHERE finding_code = 'SAN_MISSING')"),
    "search_finding_code_contains": (
        I.SearchFilters(finding_code_contains="validity"),
        "c.cert_hash IN (SELECT cert_hash FROM cert_findings WHERE position('validity' IN lower(finding_code)) > 0)"),
    "search_wildcard": (I.SearchFilters(has_wildcard=True), "c.has_wildcard = 1"),
    "search_punycode": (I.SearchFilters(has_punycode=True), "c.has_punycode = 1"),
    "search_validity": (I.SearchFilters(min_validity_days=100, max_validity_days=400),
                        "c.validity_days >= 100 AND c.validity_days <= 400"),
    "search_min_score": (I.SearchFilters(min_anomaly_score=50), "c.anomaly_score >= 50"),
    "search_combined": (
        I.SearchFilters(registered_domain="site3.example", eku_contains="server", has_wildcard=False,
                        min_validity_days=50, finding_code_contains="_"),
        "o.registered_domain = 'site3.example' AND "
        "len(list_filter(c.eku, lambda e: position('server' IN lower(e)) > 0)) > 0 AND c.has_wildcard = 0 AND "
        "c.validity_days >= 50 AND "
        "c.cert_hash IN (SELECT cert_hash FROM cert_findings WHERE position('_' IN lower(finding_code)) > 0)"),
}


def _search_sql(where: str) -> str:
    return f"""
SELECT c.cert_hash, c.subject_cn, c.issuer_dn, c.dns_names[1:10] AS dns_names, c.eku,
       {O.VALIDATION_SQL} AS validation_type, c.validity_days,
       c.has_wildcard = 1 AS has_wildcard, c.has_punycode = 1 AS has_punycode, c.anomaly_score,
       max(o.seen_at) AS last_seen, min(o.registered_domain) AS registered_domain
FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
WHERE {O.trailing('o.seen_at', ROLLUP_DAYS)} AND {where}
GROUP BY c.cert_hash, c.subject_cn, c.issuer_dn, c.dns_names, c.eku, c.policy_oids, c.validity_days,
         c.has_wildcard, c.has_punycode, c.anomaly_score
ORDER BY last_seen DESC, c.anomaly_score DESC, c.cert_hash ASC LIMIT {SEARCH_LIMIT}
"""


def _search_query(name: str, filters: I.SearchFilters, where: str):
    def run(spark, d):
        t = A.tables(spark, d)
        return I.search_certificates(t.observations, t.certificates, t.findings,
                                     Span.trailing(AS_OF, ROLLUP_DAYS), SEARCH_LIMIT, filters)
    register(name, "I2", _search_sql(where))(run)


for _name, (_filters, _where) in SEARCHES.items():
    _search_query(_name, _filters, _where)


# The "contains" searches again, through the trigram index; a needle of two letters and
# all four fields together besides.
INDEXED = {
    **{name.replace("search_", "search_index_"): SEARCHES[name] for name in ("search_subject_cn", "search_issuer", "search_eku", "search_finding_code_contains")},
    "search_index_short": (I.SearchFilters(issuer_contains="EH"), "position('eh' IN lower(c.issuer_dn)) > 0"),
    "search_index_all": (
        I.SearchFilters(subject_cn_contains="omer#0000", issuer_contains="=", eku_contains="server", finding_code_contains="SAN_", has_wildcard=False),
        "position('omer#0000' IN lower(c.subject_cn)) > 0 AND position('=' IN lower(c.issuer_dn)) > 0 AND c.has_wildcard = 0 AND "
        "len(list_filter(c.eku, lambda e: position('server' IN lower(e)) > 0)) > 0 AND "
        "c.cert_hash IN (SELECT cert_hash FROM cert_findings WHERE position('san_' IN lower(finding_code)) > 0)"),
}


def search_index(spark, d) -> str:
    """The index of the given tables, written on first use."""
    root = f"{store.ensure_tables(spark, d)}/search-index"
    if root not in _BUILT:
        t = A.tables(spark, d)
        _BUILT.add(Tg.build_index(t.certificates, t.findings, root))
    return root


_BUILT: set[str] = set()


def _indexed_query(name: str, filters: I.SearchFilters, where: str):
    def run(spark, d):
        t = A.tables(spark, d)
        return Tg.search_indexed(search_index(spark, d), t.observations, t.certificates, t.findings, Span.trailing(AS_OF, ROLLUP_DAYS), SEARCH_LIMIT, filters)
    register(name, "I2", _search_sql(where))(run)


for _name, (_filters, _where) in INDEXED.items():
    _indexed_query(_name, _filters, _where)


@register("domain_activity", "I3", f"""
, o AS (SELECT DISTINCT seen_at, cert_hash FROM observations
        WHERE registered_domain = '{ACTIVITY_DOMAIN}' AND {O.trailing('seen_at', TRAILING_DAYS)}),
ev_latest AS (SELECT cert_hash, arg_max(evidence_json, created_at) AS anomaly_evidence FROM cert_findings
       WHERE finding_code = 'ANOMALY_SCORE' GROUP BY 1)
SELECT o.seen_at, c.cert_hash, c.subject_cn, c.dns_names[1:10] AS dns_names, c.anomaly_score, c.issuer_dn,
       COALESCE(CAST(json_extract(ev_latest.anomaly_evidence, '$.top_signals') AS VARCHAR), '[]') AS top_signals_json
FROM o JOIN certificates c ON c.cert_hash = o.cert_hash LEFT JOIN ev_latest ON ev_latest.cert_hash = c.cert_hash
ORDER BY o.seen_at DESC, c.cert_hash ASC LIMIT 25
""")
def domain_activity(spark, d):
    t = A.tables(spark, d)
    return I.domain_activity(t.observations, t.certificates, t.findings, ACTIVITY_DOMAIN,
                             Span.trailing(AS_OF, TRAILING_DAYS), 25)
