"""DuckDB twins of the registered queries (the correctness oracle).

Each statement starts with the FIXTURES adapter views as CTEs, so DuckDB
reads the same raw tables the Spark queries read.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

ADAPTER_CTES = """
WITH ev AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         user_id * 5 + event_id % 5 AS cert_no
  FROM events
),
observations AS (
  SELECT ts AS seen_at,
         concat('cert-', CAST(cert_no AS STRING)) AS cert_hash,
         CASE WHEN k % 20 = 0 THEN '' ELSE concat('site', CAST(k % 20 AS STRING), '.example') END AS registered_domain,
         concat('issuer-', CAST(cert_no % 3 AS STRING)) AS issuer_key,
         event_type AS log_id, 'certstream' AS source
  FROM ev
),
certificate_versions AS (
  SELECT concat('cert-', CAST(c_custkey AS STRING)) AS cert_hash,
         c_name AS subject_cn,
         c_mktsegment AS issuer_cn,
         concat('CN=', c_mktsegment) AS issuer_dn,
         concat('issuer-', CAST(c_custkey % 3 AS STRING)) AS issuer_key,
         split(concat('www.site', CAST(c_custkey % 20 AS STRING), '.example,login.site', CAST(c_custkey % 20 AS STRING), '.example'), ',') AS dns_names,
         CAST(c_nationkey + c_custkey % 3 AS INT) AS san_count,
         CAST(floor(abs(c_acctbal) / 12) AS INT) AS validity_days,
         CASE c_custkey % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' ELSE 'Ed25519' END AS key_type,
         CASE c_custkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 ELSE 256 END AS key_size,
         CASE c_custkey % 5 WHEN 0 THEN 'SHA1' WHEN 1 THEN 'SHA384' ELSE 'SHA256' END AS sig_alg,
         split(CASE c_custkey % 4 WHEN 0 THEN 'serverAuth' WHEN 1 THEN 'serverAuth,clientAuth' WHEN 2 THEN 'emailProtection' ELSE 'clientAuth,serverAuth' END, ',') AS eku,
         split(CASE c_custkey % 5 WHEN 0 THEN '2.23.140.1.1' WHEN 1 THEN '2.23.140.1.2.2' WHEN 2 THEN '2.23.140.1.2.1' WHEN 3 THEN '2.23.140.1.2.1,2.23.140.1.2.2' ELSE '1.3.6.1.4.1' END, ',') AS policy_oids,
         CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS has_wildcard,
         CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS has_punycode,
         CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS has_ip_san,
         CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS has_uri_san,
         CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS has_email_san,
         CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS has_must_staple,
         CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS basic_constraints_ca,
         ts AS last_seen, event_id AS ingest_seq,
         CAST(CAST(floor(value) AS INT) % 101 AS INT) AS anomaly_score
  FROM ev JOIN customer ON c_custkey = cert_no
),
certificates AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cert_hash ORDER BY last_seen DESC, ingest_seq DESC) AS rn
    FROM certificate_versions) t
  WHERE rn = 1
),
cert_findings AS (
  SELECT concat('cert-', CAST(cert_no AS STRING)) AS cert_hash,
         CASE WHEN event_type = 'purchase' THEN 'ANOMALY_SCORE' WHEN k % 3 = 0 THEN 'VALIDITY_LONG'
              WHEN k % 3 = 1 THEN 'SAN_MISSING' ELSE 'CN_NOT_IN_SAN' END AS finding_code,
         CASE WHEN event_type = 'purchase' THEN 'info' WHEN k % 3 = 0 THEN 'medium'
              WHEN k % 3 = 1 THEN 'high' ELSE 'info' END AS severity,
         concat('{"anomaly_score": ', CAST(CAST(floor(value) AS INT) % 101 AS STRING), ', "top_signals": []}') AS evidence_json,
         ts AS created_at
  FROM ev WHERE event_type IN ('purchase', 'error')
),
hosts AS (
  SELECT page_id, regexp_extract(url, 'https?://([^/:?#]+)', 1) AS host FROM pages
)
"""

VALIDATION_SQL = ("CASE WHEN list_contains(policy_oids, '2.23.140.1.1') THEN 'EV' "
                  "WHEN list_contains(policy_oids, '2.23.140.1.2.2') THEN 'OV' "
                  "WHEN list_contains(policy_oids, '2.23.140.1.2.1') THEN 'DV' ELSE 'Unknown' END")
EKU_SET_SQL = "CASE WHEN len(eku) = 0 THEN '(none)' ELSE array_to_string(list_sort(eku), ',') END"
UNUSUAL_EKU_SQL = "CASE WHEN len(eku) > 0 AND NOT list_contains(eku, 'serverAuth') THEN 1 ELSE 0 END"

DIM_SQL = {
    "issuer_cn": "issuer_cn",
    "issuer_dn": "issuer_dn",
    "validation_type": VALIDATION_SQL,
    "sig_alg": "sig_alg",
    "key_type": "key_type",
    "key_size": "CAST(key_size AS VARCHAR)",
    "eku_set": EKU_SET_SQL,
    "anomaly_bucket": ("CASE WHEN anomaly_score >= 60 THEN '60+' WHEN anomaly_score >= 30 THEN '30-59' "
                       "WHEN anomaly_score >= 10 THEN '10-29' ELSE '0-9' END"),
    "validity_bucket": ("CASE WHEN validity_days <= 90 THEN '0-90' WHEN validity_days <= 180 THEN '91-180' "
                        "WHEN validity_days <= 397 THEN '181-397' ELSE '398+' END"),
    "san_count_bucket": ("CASE WHEN san_count = 1 THEN '1' WHEN san_count <= 5 THEN '2-5' "
                         "WHEN san_count <= 25 THEN '6-25' ELSE '26+' END"),
}


def with_adapters(sql: str) -> str:
    return ADAPTER_CTES + sql


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


def trailing(col: str, days: int) -> str:
    return f"{col} >= {AS_OF} - INTERVAL {days} DAY"


def in_range(col: str, date_from: str, date_to: str) -> str:
    return f"{col} >= DATE '{date_from}' AND {col} < DATE '{date_to}' + INTERVAL 1 DAY"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_sql(col: str) -> str:
    return f"regexp_replace(lower(trim({col})), '\\.+$', '')"


def psl_ctes(source: str, host_col: str = "host") -> str:
    """CTEs computing ``regdom(host, registered_domain)`` for the distinct
    hosts of ``source`` with the same longest-match rule logic."""
    from certlens.sources.psl import FIXTURE_RULES
    rows = []
    for rule in FIXTURE_RULES:
        if rule.startswith("!"):
            rows.append((rule[1:], "exception"))
        elif rule.startswith("*."):
            rows.append((rule[2:], "wildcard"))
        else:
            rows.append((rule, "normal"))
    values = ", ".join(f"({_sql_str(s)}, {_sql_str(k)})" for s, k in rows)
    return f""",
psl_rules(suffix, kind) AS (VALUES {values}),
psl_h AS (SELECT DISTINCT {host_col} AS host FROM {source} WHERE {host_col} IS NOT NULL),
psl_n AS (SELECT host, {norm_sql('host')} AS norm FROM psl_h),
psl_b AS (SELECT host, v, string_split(v, '.') AS labels, len(string_split(v, '.')) AS n
          FROM (SELECT host, regexp_replace(CASE WHEN starts_with(norm, '*.') THEN norm[3:] ELSE norm END,
                                            '^\\.+', '') AS v FROM psl_n) x),
psl_c AS (SELECT host, n, k, array_to_string(labels[n - k + 1:], '.') AS suffix
          FROM (SELECT host, n, labels, unnest(range(1, n + 1)) AS k FROM psl_b WHERE v <> '') y),
psl_hits AS (SELECT host, max(CASE WHEN kind = 'exception' THEN k END) AS exc_k,
                    max(CASE WHEN kind = 'normal' THEN k END) AS norm_k,
                    max(CASE WHEN kind = 'wildcard' AND k < n THEN k + 1 END) AS wild_k
             FROM psl_c JOIN psl_rules USING (suffix) GROUP BY host),
psl_len AS (SELECT b.host, b.v, b.labels, b.n,
                   CASE WHEN exc_k IS NOT NULL THEN exc_k - 1
                        ELSE greatest(coalesce(norm_k, 0), coalesce(wild_k, 0), 1) END AS ps_len
            FROM psl_b b LEFT JOIN psl_hits h ON h.host = b.host),
regdom AS (SELECT host, CASE WHEN v = '' THEN ''
                             ELSE array_to_string(labels[n - least(ps_len + 1, n) + 1:], '.') END AS registered_domain
           FROM psl_len)"""


def tokens_sql(host: str) -> str:
    labels = f"list_filter(string_split(regexp_replace({norm_sql(host)}, '^[*.]+', ''), '.'), lambda x: x <> '')"
    return (f"list_transform(range(1, len({labels}) + 1), lambda i: array_to_string({labels}[i:], '.'))")


def entropy_sql(s: str) -> str:
    """Shannon entropy (bits/char) of string expression ``s``."""
    cnt = f"(length({s}) - length(replace({s}, ch, '')))"
    return (f"CASE WHEN length({s}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({s}, '')), "
            f"lambda ch: ({cnt} / length({s})) * log2({cnt} / length({s})))) END")


def label_entropy_sql(host: str) -> str:
    labels = f"list_filter(string_split({norm_sql(host)}, '.'), lambda lab: regexp_full_match(lab, '[a-z0-9-]+'))"
    return (f"coalesce(list_max(list_transform({labels}, lambda lab: {entropy_sql('lab')})), 0.0)")
