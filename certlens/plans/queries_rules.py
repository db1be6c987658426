"""Registered rule queries: lint findings (C), anomaly signals and score (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from certlens import oracle as O
from certlens.catalog import AS_OF, ROLLUP_DAYS, register
from certlens.config import DEFAULT, SUSPICIOUS_KEYWORDS
from certlens.operators import baseline as B
from certlens.operators import lint as Ln
from certlens.operators import rollups as R
from certlens.operators import signals as Sg
from certlens.operators.certfeatures import attach_name_features
from certlens.plans import rescore as Rs
from certlens.sources import adapters as A
from certlens.sources import psl

T = DEFAULT.thresholds
W = DEFAULT.weights


def scoring_input(spark, d, with_bursts: bool = True, with_baseline: bool = True):
    """Latest certificates (full schema) with name features, org tokens,
    burst matches and issuer baselines, as the scoring job prepares them."""
    certs = A.certificates(spark, d, full_schema=True)
    obs = A.observations(spark, d)
    rules = psl.rules_frame(spark, psl.FIXTURE_RULES)
    bursts = B.domain_bursts(obs, AS_OF, T.domain_burst_window_hours) if with_bursts else None
    feats = attach_name_features(certs, rules, len(psl.FIXTURE_RULES), bursts, T.domain_burst_count)
    feats = Ln.with_org_tokens(feats)
    if not with_baseline:
        return Sg.attach_baseline(feats, None)
    daily = R.daily_cert_counts(obs, certs, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)
    base = B.baselines(obs, certs, daily, AS_OF, ROLLUP_DAYS)
    return Sg.attach_baseline(feats, base)


# ---- DuckDB twin ----------------------------------------------------------
# The adapter certificates have no subject_org / subject_dn / key_usage / OCSP
# URLs; the twin supplies the same defaults the Spark conform step adds.
_FULL = f"""
, fc AS (
  SELECT *, '' AS subject_org, '' AS subject_dn, CAST([] AS VARCHAR[]) AS key_usage,
         CAST([] AS VARCHAR[]) AS aia_ocsp_urls,
         CASE WHEN regexp_matches(issuer_dn, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END AS issuer_has_non_ascii,
         0 AS subject_has_non_ascii, {O.VALIDATION_SQL} AS validation_type
  FROM certificates)
"""

_LINT_RULES = [
    ("SAN_MISSING", "'high'", "san_count = 0", "json_object('subject_cn', subject_cn)"),
    ("CN_NOT_IN_SAN", "'info'", "subject_cn <> '' AND NOT list_contains(dns_names, subject_cn)",
     "json_object('dns_names', dns_names[1:5], 'subject_cn', subject_cn)"),
    ("RSA_KEY_TOO_SMALL", "'high'", "key_type = 'RSA' AND key_size < 2048", "json_object('key_size', key_size)"),
    ("DEPRECATED_SIG_ALGORITHM", "'high'", "upper(sig_alg) IN ('MD5', 'SHA1')", "json_object('sig_alg', sig_alg)"),
    ("VALIDITY_TOO_LONG", "'high'", f"validity_days > {T.high_validity_days}",
     "json_object('validity_days', validity_days)"),
    ("VALIDITY_LONG", "'medium'",
     f"validity_days <= {T.high_validity_days} AND validity_days > {T.medium_validity_days}",
     "json_object('validity_days', validity_days)"),
    ("EKU_MISSING_SERVER_AUTH", "'medium'", "len(eku) > 0 AND NOT list_contains(eku, 'serverAuth')",
     "json_object('eku', eku)"),
    ("LEAF_MARKED_CA", "'high'", "basic_constraints_ca <> 0",
     "json_object('basic_constraints_ca', basic_constraints_ca)"),
    ("LEAF_KEY_USAGE_CA_BITS", "'high'", "len(list_intersect(['keyCertSign', 'cRLSign'], key_usage)) > 0",
     "json_object('key_usage', list_sort(list_intersect(['keyCertSign', 'cRLSign'], key_usage)))"),
    ("DN_NON_ASCII", "'low'", "subject_has_non_ascii <> 0 OR issuer_has_non_ascii <> 0",
     "json_object('issuer_has_non_ascii', issuer_has_non_ascii, 'subject_has_non_ascii', subject_has_non_ascii)"),
    ("DN_SUSPICIOUS_FORMATTING", "'medium'",
     "regexp_matches(subject_dn, '\\s{2,}|(^,)|(,,)|,\\s*,') OR regexp_matches(issuer_dn, '\\s{2,}|(^,)|(,,)|,\\s*,')",
     "json_object('issuer_dn', issuer_dn, 'subject_dn', subject_dn)"),
    ("AIA_OCSP_MISSING", "'info'", "len(aia_ocsp_urls) = 0", "'{}'"),
    # Organisation rules need a non-empty subject_org; IDN_CONFUSABLE needs an
    # xn-- name (IDNA decoding has no SQL equivalent). Neither occurs in the
    # adapter rows, which the rows-in/rows-out tests check separately.
    ("ORG_BRAND_IMPERSONATION", "'low'", "subject_org <> '' AND FALSE", "'{}'"),
    ("ORG_DOMAIN_MISMATCH", "'low'", "subject_org <> '' AND FALSE", "'{}'"),
    ("IDN_CONFUSABLE", "'medium'", "len(list_filter(dns_names[1:10], lambda n: contains(n, 'xn--'))) > 0 AND FALSE",
     "'{}'"),
]

_LINT_SQL = _FULL + "\n" + "\nUNION ALL\n".join(
    f"SELECT cert_hash, '{code}' AS finding_code, {sev} AS severity, CAST({ev} AS VARCHAR) AS evidence_json, "
    f"{O.AS_OF} AS created_at FROM fc WHERE {cond}"
    for code, sev, cond, ev in _LINT_RULES)


@register("lint_findings", "C", _LINT_SQL)
def lint_findings(spark, d):
    certs = A.certificates(spark, d, full_schema=True)
    feats = Ln.with_org_tokens(attach_name_features(certs, psl.rules_frame(spark, psl.FIXTURE_RULES), len(psl.FIXTURE_RULES)))
    return Ln.lint_findings(feats, AS_OF)


_DAILY = f"""
daily AS (
  SELECT CAST(o.seen_at AS DATE) AS day, o.issuer_key, count(DISTINCT o.cert_hash) AS cert_count
  FROM observations o JOIN certificates c ON c.cert_hash = o.cert_hash
  WHERE o.seen_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2)"""

_KW = ", ".join(f"'{k}'" for k in SUSPICIOUS_KEYWORDS)
def signals_sql(days: int = ROLLUP_DAYS, baseline: bool = True, bursts: bool = True,
                candidates: str | None = None) -> str:
    """SQL twin of the signal rules (no baseline / bursts = fast mode);
    ``candidates`` restricts the scored certificates by a cert_hash query."""
    cand = f"WHERE c.cert_hash IN ({candidates})" if candidates else ""
    base_on = "" if baseline else "AND FALSE"
    burst_on = "" if bursts else "AND FALSE"
    return O.psl_ctes("(SELECT unnest(dns_names) AS host FROM certificates)") + f"""
, {_DAILY.strip()},
wobs AS (SELECT o.issuer_key, c.* EXCLUDE (issuer_key) FROM observations o JOIN certificates c
         ON c.cert_hash = o.cert_hash WHERE {O.trailing('o.seen_at', days)}),
base AS (SELECT issuer_key, quantile_cont(validity_days, 0.95) AS validity_p95,
                avg(has_wildcard) AS wildcard_rate, avg(has_punycode) AS punycode_rate
         FROM wobs GROUP BY 1),
eku_ranked AS (SELECT issuer_key, eku_key,
                      row_number() OVER (PARTITION BY issuer_key ORDER BY cnt DESC, eku_key) AS rnk
               FROM (SELECT issuer_key, array_to_string(list_sort(eku), ',') AS eku_key, count(*) AS cnt
                     FROM wobs GROUP BY 1, 2) e),
eku_sets AS (SELECT issuer_key, list(eku_key) AS common_eku_sets FROM eku_ranked
             WHERE rnk <= 5 AND eku_key <> '' GROUP BY 1),
spk AS (SELECT issuer_key, max(CASE WHEN rn = 1 THEN cert_count END) AS current_day_count,
               COALESCE(avg(CASE WHEN rn > 1 THEN cert_count END), 0.0) AS trailing_daily_avg
        FROM (SELECT issuer_key, cert_count, row_number() OVER (PARTITION BY issuer_key ORDER BY day DESC) AS rn
              FROM daily WHERE day >= DATE '2024-01-23') s WHERE rn <= 8 GROUP BY 1),
bkeys AS (SELECT issuer_key FROM base UNION SELECT issuer_key FROM eku_sets UNION SELECT issuer_key FROM spk),
bursts AS (SELECT registered_domain, count(DISTINCT cert_hash) AS cert_count FROM observations
           WHERE seen_at >= {O.AS_OF} - INTERVAL {T.domain_burst_window_hours} HOUR AND registered_domain <> ''
           GROUP BY 1),
cert_bursts AS (
  SELECT cert_hash, list({{'cert_count': cert_count, 'registered_domain': rd}}
                         ORDER BY cert_count DESC, rd) AS matches
  FROM (SELECT DISTINCT n.cert_hash, r.registered_domain AS rd, b.cert_count
        FROM (SELECT cert_hash, unnest(dns_names) AS name FROM certificates) n
        JOIN regdom r ON r.host = n.name JOIN bursts b ON b.registered_domain = r.registered_domain
        WHERE b.cert_count >= {T.domain_burst_count}) x
  GROUP BY 1),
sc AS (
  SELECT c.*, b.validity_p95, b.wildcard_rate, b.punycode_rate, e.common_eku_sets, s.current_day_count,
         s.trailing_daily_avg, k.issuer_key IS NOT NULL AS has_baseline, cb.matches,
         list_sort(list_distinct(flatten(list_transform(c.dns_names,
           lambda n: list_filter([{_KW}], lambda kw: contains({O.norm_sql('n')}, kw)))))) AS keywords,
         list_filter(list_transform(c.dns_names, lambda n: round({O.label_entropy_sql('n')}, 3)),
                     lambda e: e >= {T.high_entropy_threshold}) AS entropy_hits
  FROM certificates c LEFT JOIN base b ON b.issuer_key = c.issuer_key {base_on}
  LEFT JOIN eku_sets e ON e.issuer_key = c.issuer_key {base_on} LEFT JOIN spk s ON s.issuer_key = c.issuer_key {base_on}
  LEFT JOIN bkeys k ON k.issuer_key = c.issuer_key {base_on} LEFT JOIN cert_bursts cb ON cb.cert_hash = c.cert_hash {burst_on}
  {cand}),
sig AS (
  SELECT cert_hash, 1 AS ordinal, 'high_san_count' AS code, 'medium' AS severity, {W.high_san} AS score
  FROM sc WHERE san_count >= {T.high_san_count}
  UNION ALL SELECT cert_hash, 2, 'wildcard_san',
    CASE WHEN wildcard_rate < {T.wildcard_baseline_rate} THEN 'medium' ELSE 'info' END, {W.wildcard}
  FROM sc WHERE has_wildcard <> 0
  UNION ALL SELECT cert_hash, 5, 'registered_domain_burst',
    CASE WHEN matches[1].cert_count >= {T.domain_burst_count * 2} THEN 'high' ELSE 'medium' END, {W.domain_burst}
  FROM sc WHERE len(matches) > 0
  UNION ALL SELECT cert_hash, 6, 'high_entropy_label', 'medium', {W.entropy} FROM sc WHERE len(entropy_hits) > 0
  UNION ALL SELECT cert_hash, 8, 'punycode_san',
    CASE WHEN punycode_rate < {T.punycode_baseline_rate} THEN 'low' ELSE 'info' END, {max(2, W.punycode // 4)}
  FROM sc WHERE has_punycode <> 0
  UNION ALL SELECT cert_hash, 10, 'suspicious_keywords', 'info', {W.keyword} FROM sc WHERE len(keywords) > 0
  UNION ALL SELECT cert_hash, 11, 'validity_outlier', 'medium', {W.validity}
  FROM sc WHERE validity_p95 IS NOT NULL AND validity_p95 <> 0 AND validity_days > validity_p95
  UNION ALL SELECT cert_hash, 12, 'validity_long', 'medium', {W.validity}
  FROM sc WHERE NOT coalesce(validity_p95 IS NOT NULL AND validity_p95 <> 0 AND validity_days > validity_p95, FALSE)
    AND validity_days > {T.medium_validity_days}
  UNION ALL SELECT cert_hash, 13, 'rare_san_types', 'medium', {W.extension}
  FROM sc WHERE has_ip_san <> 0 OR has_uri_san <> 0 OR has_email_san <> 0
  UNION ALL SELECT cert_hash, 14, 'unusual_eku_set', 'medium', {W.eku}
  FROM sc WHERE has_baseline AND len(eku) > 0 AND len(coalesce(common_eku_sets, [])) > 0
    AND NOT list_contains(coalesce(common_eku_sets, []), array_to_string(list_sort(eku), ','))
  UNION ALL SELECT cert_hash, 15, 'issuer_spike', 'high', {W.spike}
  FROM sc WHERE trailing_daily_avg IS NOT NULL AND trailing_daily_avg <> 0
    AND current_day_count > trailing_daily_avg * {T.spike_multiplier})
"""


_SIGNALS_SQL = signals_sql()


@register("anomaly_signals", "D", _SIGNALS_SQL + "SELECT cert_hash, ordinal, code, severity, score FROM sig")
def anomaly_signals(spark, d):
    scored = Sg.score_certificates(scoring_input(spark, d))
    return Sg.signal_rows(scored).select("cert_hash", "ordinal", "code", "severity", "score")


@register("anomaly_score", "D16", _SIGNALS_SQL + f"""
, ranked AS (SELECT cert_hash, code, row_number() OVER (PARTITION BY cert_hash ORDER BY score DESC, ordinal) AS r,
                    sum(score) OVER (PARTITION BY cert_hash) AS total FROM sig)
SELECT c.cert_hash, CAST(least(coalesce(max(total), 0), 100) AS INTEGER) AS anomaly_score,
       coalesce(string_agg(code, ',' ORDER BY r) FILTER (WHERE r <= 3), '') AS top_signal_codes
FROM certificates c LEFT JOIN ranked k ON k.cert_hash = c.cert_hash
GROUP BY c.cert_hash
""")
def anomaly_score(spark, d):
    scored = Sg.score_certificates(scoring_input(spark, d))
    return scored.select("cert_hash", F.col("anomaly_score").cast("int").alias("anomaly_score"),
                         F.array_join(F.transform("top_signals", lambda s: s["code"]), ",").alias("top_signal_codes"))


@register("anomaly_findings", "D17")
def anomaly_findings(spark, d):
    scored = Sg.score_certificates(scoring_input(spark, d))
    return Sg.anomaly_finding(scored, AS_OF)



_LINT_RESULTS_SQL = """
, lr AS (
  SELECT concat('cert-', CAST(cert_no AS STRING)) AS cert_hash,
         '{"results": {"e_' || event_type || '_rule": {"result": "' ||
         CASE k % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' WHEN 3 THEN 'notice' ELSE 'NA' END ||
         '", "details": "k=' || CAST(k AS VARCHAR) || '", "source": "RFC 5280"}, "n_value.' || CAST(k % 7 AS VARCHAR) ||
         '": "' || CASE k % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'fatal' WHEN 2 THEN 'ne' ELSE 'bogus' END || '"}}'
           AS result_json
  FROM ev),
items AS (
  SELECT cert_hash, key AS lint_name, json_extract(json_extract(result_json, '$.results'), '$."' || key || '"') AS raw
  FROM (SELECT cert_hash, result_json, unnest(json_keys(json_extract(result_json, '$.results'))) AS key FROM lr) x),
parsed AS (
  SELECT cert_hash, lint_name,
         lower(CASE WHEN json_type(raw) = 'OBJECT'
                    THEN coalesce(nullif(json_extract_string(raw, '$.result'), ''),
                                  nullif(json_extract_string(raw, '$.status'), ''), '')
                    ELSE json_extract_string(raw, '$') END) AS status,
         CASE WHEN json_type(raw) = 'OBJECT'
              THEN coalesce(nullif(json_extract_string(raw, '$.details'), ''),
                            nullif(json_extract_string(raw, '$.detail'), ''), '') ELSE '' END AS details,
         CASE WHEN json_type(raw) = 'OBJECT' THEN json_extract_string(raw, '$.source') END AS source
  FROM items)
SELECT cert_hash, 'ZLINT_' || regexp_replace(upper(lint_name), '[^a-zA-Z0-9]', '_', 'g') AS finding_code,
       CASE status WHEN 'fatal' THEN 'high' WHEN 'error' THEN 'high' WHEN 'warn' THEN 'medium'
                   WHEN 'notice' THEN 'low' WHEN 'info' THEN 'info' ELSE 'low' END AS severity,
       CAST(json_object('details', details, 'source', source, 'zlint_name', lint_name, 'zlint_result', status,
                        'zlint_version', 'unknown') AS VARCHAR) AS evidence_json,
       """ + O.AS_OF + """ AS created_at
FROM parsed
WHERE status <> '' AND status NOT IN ('pass', 'na', 'ne', 'not applicable', 'not effective')
"""


@register("external_lint_findings", "A20", _LINT_RESULTS_SQL)
def external_lint_findings(spark, d):
    from certlens.operators.external_lint import external_lint_findings as run
    return run(A.lint_results(spark, d), AS_OF)


_TOP_CODES = """
, ranked AS (SELECT cert_hash, code, row_number() OVER (PARTITION BY cert_hash ORDER BY score DESC, ordinal) AS r,
                    sum(score) OVER (PARTITION BY cert_hash) AS total FROM sig)
SELECT c.cert_hash, CAST(least(coalesce(max(total), 0), 100) AS BIGINT) AS anomaly_score,
       coalesce(string_agg(code, ',' ORDER BY r) FILTER (WHERE r <= 3), '') AS top_signal_codes
FROM certificates c LEFT JOIN ranked k ON k.cert_hash = c.cert_hash
WHERE c.cert_hash IN ({cands})
GROUP BY c.cert_hash
"""
_RESCORE_CANDS = f"SELECT DISTINCT cert_hash FROM cert_findings WHERE finding_code = 'ANOMALY_SCORE' AND {O.trailing('created_at', 14)}"
_FAST_CANDS = f"SELECT DISTINCT cert_hash FROM certificates WHERE {O.trailing('last_seen', 14)}"


def _scores_from_findings(df):
    ev = F.col("evidence_json")
    codes = F.from_json(F.get_json_object(ev, "$.top_signals"), "array<struct<code:string>>")
    return df.select("cert_hash", F.get_json_object(ev, "$.anomaly_score").cast("long").alias("anomaly_score"),
                     F.array_join(F.transform(codes, lambda x: x["code"]), ",").alias("top_signal_codes"))


@register("rescore_scores", "D18", signals_sql(14, candidates=_RESCORE_CANDS)
          + _TOP_CODES.format(cands=_RESCORE_CANDS))
def rescore_scores(spark, d):
    t = A.tables(spark, d)
    return _scores_from_findings(Rs.rescore(spark, t.observations, t.certificates, t.findings, AS_OF, 14, rules=psl.FIXTURE_RULES))


@register("rescore_fast_scores", "D18", signals_sql(14, baseline=False, bursts=False, candidates=_FAST_CANDS)
          + _TOP_CODES.format(cands=_FAST_CANDS))
def rescore_fast_scores(spark, d):
    t = A.tables(spark, d)
    return _scores_from_findings(Rs.rescore(spark, t.observations, t.certificates, t.findings, AS_OF, 14, all_certs=True, fast=True,
                                            rules=psl.FIXTURE_RULES))


# ---- every rule and signal fires ---------------------------------------------
# What each class of ``rule_case_certificates`` must give, by the rules' definitions.
LINT_CASES = {
    1: [("SAN_MISSING", "high")], 2: [("CN_NOT_IN_SAN", "info")], 3: [("RSA_KEY_TOO_SMALL", "high"), ("DEPRECATED_SIG_ALGORITHM", "high")],
    4: [("VALIDITY_TOO_LONG", "high")], 5: [("VALIDITY_LONG", "medium")], 6: [("EKU_MISSING_SERVER_AUTH", "medium")],
    7: [("LEAF_MARKED_CA", "high"), ("LEAF_KEY_USAGE_CA_BITS", "high")], 8: [("DN_NON_ASCII", "low")], 9: [("DN_SUSPICIOUS_FORMATTING", "medium")],
    10: [("AIA_OCSP_MISSING", "info")], 11: [("ORG_BRAND_IMPERSONATION", "medium"), ("ORG_DOMAIN_MISMATCH", "medium")],
    12: [("IDN_CONFUSABLE", "medium")], 14: [("IDN_CONFUSABLE", "medium")],
}
#: (code, severity, score)
SIGNAL_CASES = {
    4: [("validity_outlier", "medium", W.validity)], 5: [("validity_long", "medium", W.validity)], 6: [("unusual_eku_set", "medium", W.eku)],
    11: [("org_domain_mismatch", "medium", W.org_domain_mismatch), ("brand_org_impersonation", "high", W.brand_org_impersonation)],
    12: [("idn_confusable", "medium", W.idn_confusable), ("punycode_san", "info", max(2, W.punycode // 4))],
    13: [("high_entropy_label", "medium", W.entropy)],
    14: [("high_entropy_label", "medium", W.entropy), ("idn_confusable", "medium", W.idn_confusable), ("punycode_san", "info", max(2, W.punycode // 4)),
         ("punycode_entropy_combo", "medium", max(W.punycode, W.entropy))],
    15: [("high_san_count", "medium", W.high_san), ("wildcard_san", "info", W.wildcard), ("registered_domain_burst", "medium", W.domain_burst),
         ("suspicious_keywords", "info", W.keyword), ("rare_san_types", "medium", W.extension), ("issuer_spike", "high", W.spike)],
}
_CASE = f"CAST(regexp_extract(cert_hash, '([0-9]+)$', 1) AS BIGINT) % {A.RULE_CASES}"


def _case_rows(spark, d):
    """The rule cases with name features, one burst domain and two issuers' baselines: an
    ordinary one and one whose newest day is far above its average."""
    bursts = spark.createDataFrame([("burst.example", T.domain_burst_count)], "registered_domain string, cert_count long")
    common = (100.0, 0.5, 0.5, ["serverAuth"])
    base = spark.createDataFrame([("quiet", *common, 10, 9.0), ("spiking", *common, 100, 9.0)],
                                 "issuer_key string, validity_p95 double, wildcard_rate double, punycode_rate double, common_eku_sets array<string>, "
                                 "current_day_count long, trailing_daily_avg double")
    certs = A.rule_case_certificates(spark, d)
    rules = psl.rules_frame(spark, psl.FIXTURE_RULES)
    feats = Ln.with_org_tokens(attach_name_features(certs, rules, len(psl.FIXTURE_RULES), bursts, T.domain_burst_count))
    return Sg.attach_baseline(feats, base)


_LINT_VALUES = ", ".join(f"({case}, '{code}', '{severity}')" for case, rows in LINT_CASES.items() for code, severity in rows)
_SIGNAL_VALUES = ", ".join(f"({case}, '{code}', '{severity}', {score})" for case, rows in SIGNAL_CASES.items() for code, severity, score in rows)


@register("lint_cases", "C", f"""
, expected(kind, finding_code, severity) AS (VALUES {_LINT_VALUES})
SELECT cert_hash, finding_code, severity FROM certificates JOIN expected ON {_CASE} = kind
""")
def lint_cases(spark, d):
    return Ln.lint_findings(_case_rows(spark, d), AS_OF).select("cert_hash", "finding_code", "severity")


@register("signal_cases", "D", f"""
, expected(kind, code, severity, score) AS (VALUES {_SIGNAL_VALUES})
SELECT cert_hash, code, severity, CAST(score AS INTEGER) AS score FROM certificates JOIN expected ON {_CASE} = kind
""")
def signal_cases(spark, d):
    return Sg.signal_rows(Sg.score_certificates(_case_rows(spark, d))).select("cert_hash", "code", "severity", "score")


@register("finding_cases", "D17", f"""
, expected(kind, code, severity, score) AS (VALUES {_SIGNAL_VALUES}),
ranked AS (SELECT kind, code, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, place) AS rank
           FROM (SELECT *, list_position([{', '.join(f"'{c}'" for c in (
               "high_san_count", "wildcard_san", "org_domain_mismatch", "brand_org_impersonation", "registered_domain_burst", "high_entropy_label", "idn_confusable", "punycode_san",
               "punycode_entropy_combo", "suspicious_keywords", "validity_outlier", "validity_long", "rare_san_types", "unusual_eku_set", "issuer_spike"))}], code) AS place FROM expected) x),
told AS (SELECT kind, least(100, sum(score)) AS anomaly_score, string_agg(code, ',' ORDER BY rank) FILTER (rank <= 3) AS top_codes FROM ranked GROUP BY kind)
SELECT cert_hash, 'ANOMALY_SCORE' AS finding_code, 'info' AS severity, CAST(coalesce(told.anomaly_score, 0) AS BIGINT) AS anomaly_score, coalesce(top_codes, '') AS top_codes
FROM certificates LEFT JOIN told ON {_CASE} = kind
""")
def finding_cases(spark, d):
    """The ANOMALY_SCORE finding of each case, its evidence read back."""
    found = Sg.anomaly_finding(Sg.score_certificates(_case_rows(spark, d)), AS_OF)
    e = F.from_json("evidence_json", "struct<anomaly_score:bigint,top_signals:array<struct<code:string,score:int,severity:string>>>")
    return found.withColumn("e", e).select("cert_hash", "finding_code", "severity", "e.anomaly_score", F.array_join(F.transform("e.top_signals", lambda x: x["code"]), ",").alias("top_codes"))
