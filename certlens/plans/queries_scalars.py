"""Registered scalar / ingest-side operator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from certlens import oracle as O
from certlens.catalog import AS_OF, register
from certlens.config import IssuerMatching, ORG_STOPWORDS, SUSPICIOUS_KEYWORDS
from certlens.functions import certcols
from certlens.functions import hostnames as Hn
from certlens.functions.unicode import with_organization_tokens
from certlens.operators import issuers as Is
from certlens.operators import latest as Lt
from certlens.operators.observations import observation_fanout
from certlens.sources import adapters as A
from certlens.sources import psl

RETENTION_DAYS = 14
FAMILY = IssuerMatching(match_mode="hybrid", issuer_substrings=("building", "Machinery"),
                        issuer_spki_hashes=("0" * 64,))


@register("hostname_normalize", "B1", f"""
SELECT page_id, {O.norm_sql('host')} AS host_norm,
       regexp_full_match(host, '(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])){{3}}') AS is_ip_literal
FROM hosts
""")
def hostname_normalize(spark, d):
    h = A.hosts(spark, d)
    return h.select("page_id", Hn.normalize_hostname("host").alias("host_norm"),
                    Hn.is_ip_literal("host").alias("is_ip_literal"))


@register("hostname_tokens", "B3", f"SELECT page_id, {O.tokens_sql('host')} AS tokens FROM hosts")
def hostname_tokens(spark, d):
    return A.hosts(spark, d).select("page_id", Hn.tokenize_domain("host").alias("tokens"))


@register("hostname_punycode", "B4", f"""
SELECT page_id, contains({O.norm_sql('host')}, 'xn--') AS has_punycode FROM hosts
""")
def hostname_punycode(spark, d):
    return A.hosts(spark, d).select("page_id", Hn.has_punycode("host").alias("has_punycode"))


@register("hostname_entropy", "B11", f"""
SELECT page_id, round({O.entropy_sql('host')}, 6) AS host_entropy,
       round({O.label_entropy_sql('host')}, 6) AS label_entropy
FROM hosts
""")
def hostname_entropy(spark, d):
    h = A.hosts(spark, d)
    return h.select("page_id", F.round(Hn.shannon_entropy("host"), 6).alias("host_entropy"),
                    F.round(Hn.highest_label_entropy("host"), 6).alias("label_entropy"))


_KW = ", ".join(f"'{k}'" for k in SUSPICIOUS_KEYWORDS)


@register("hostname_keywords", "B13", f"""
SELECT page_id, list_filter([{_KW}], lambda kw: contains({O.norm_sql('host')}, kw)) AS keywords FROM hosts
""")
def hostname_keywords(spark, d):
    return A.hosts(spark, d).select("page_id", Hn.suspicious_keywords("host").alias("keywords"))


@register("registered_domain", "B2", O.psl_ctes("hosts") + """
SELECT h.page_id, h.host, r.registered_domain FROM hosts h LEFT JOIN regdom r ON r.host = h.host
""")
def registered_domain(spark, d):
    h = A.hosts(spark, d)
    rules = psl.rules_frame(spark, psl.FIXTURE_RULES)
    return psl.with_registered_domain(h, "host", "registered_domain", rules, len(psl.FIXTURE_RULES)).select(
        "page_id", "host", "registered_domain")


_STOP = ", ".join(f"'{w}'" for w in ORG_STOPWORDS)


def _org_tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '[a-z0-9]+'), "
            f"lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t))")


@register("org_tokens", "B6", f"""
SELECT c_custkey, {_org_tokens_sql('c_name')} AS org_tokens FROM customer
""")
def org_tokens(spark, d):
    c = A.read_table(spark, d, "customer")
    return with_organization_tokens(c.select("c_custkey", "c_name"), "c_name", "org_tokens").drop("c_name")


@register("registered_domain_tokens", "B7", O.psl_ctes("hosts") + f"""
SELECT h.page_id,
       flatten(list_transform(string_split(r.registered_domain, '.'), lambda lab: {_org_tokens_sql('lab')}))
         AS domain_tokens
FROM hosts h JOIN regdom r ON r.host = h.host
""")
def registered_domain_tokens(spark, d):
    h = A.hosts(spark, d)
    rules = psl.rules_frame(spark, psl.FIXTURE_RULES)
    r = psl.with_registered_domain(h, "host", "rd", rules, len(psl.FIXTURE_RULES))
    # Tokens never span a '.', so tokenising the whole registered domain equals
    # the concatenation of the per-label token lists.
    return with_organization_tokens(r.select("page_id", "rd"), "rd", "domain_tokens").drop("rd")


@register("cert_buckets", "B15", f"""
SELECT cert_hash, {O.VALIDATION_SQL} AS validation_type, {O.EKU_SET_SQL} AS eku_set,
       array_to_string(list_sort(eku), ',') AS eku_key, {O.UNUSUAL_EKU_SQL} = 1 AS unusual_eku,
       {O.DIM_SQL['anomaly_bucket']} AS anomaly_bucket, {O.DIM_SQL['validity_bucket']} AS validity_bucket,
       {O.DIM_SQL['san_count_bucket']} AS san_count_bucket
FROM certificates
""")
def cert_buckets(spark, d):
    c = A.certificates(spark, d)
    return c.select("cert_hash", certcols.validation_type().alias("validation_type"),
                    certcols.eku_set().alias("eku_set"), certcols.eku_key().alias("eku_key"),
                    certcols.unusual_eku().alias("unusual_eku"), certcols.anomaly_bucket().alias("anomaly_bucket"),
                    certcols.validity_bucket().alias("validity_bucket"),
                    certcols.san_count_bucket().alias("san_count_bucket"))


@register("finding_code_labels", "B21", """
SELECT finding_code, CAST(count(*) AS BIGINT) AS findings,
       CASE WHEN finding_code IS NULL OR finding_code = '' THEN 'none'
            WHEN starts_with(finding_code, 'ZLINT_')
              THEN 'ZLint: ' || replace(lower(regexp_replace(finding_code, '^ZLINT_[A-Z]_', '')), '_', ' ')
            ELSE replace(lower(finding_code), '_', ' ') END AS label
FROM cert_findings GROUP BY finding_code
""")
def finding_code_labels(spark, d):
    f = A.cert_findings(spark, d)
    return (f.groupBy("finding_code").agg(F.count("*").cast("long").alias("findings"))
            .withColumn("label", certcols.finding_code_label("finding_code")))


@register("observation_fanout", "A11", O.psl_ctes("(SELECT unnest(dns_names) AS host FROM certificate_versions)")
          + f"""
, names AS (SELECT ingest_seq, last_seen, cert_hash, issuer_key, unnest(dns_names) AS name
            FROM certificate_versions),
per AS (SELECT n.ingest_seq, n.last_seen, n.cert_hash, n.issuer_key, r.registered_domain,
               list_sort(list_distinct(flatten(list({O.tokens_sql('n.name')})))) AS domain_tokens
        FROM names n JOIN regdom r ON r.host = n.name
        WHERE r.registered_domain <> ''
        GROUP BY 1, 2, 3, 4, 5)
SELECT last_seen AS seen_at, cert_hash, registered_domain, issuer_key, 'ct-log' AS log_id,
       'certstream' AS source, domain_tokens
FROM per
""")
def observation_fanout_query(spark, d):
    v = A.certificate_versions(spark, d).select(
        F.col("ingest_seq").alias("event_id"), F.col("last_seen").alias("seen_at"), "cert_hash", "issuer_key",
        F.lit("ct-log").alias("log_id"), "dns_names")
    rules = psl.rules_frame(spark, psl.FIXTURE_RULES)
    return observation_fanout(v, rules, len(psl.FIXTURE_RULES))


@register("issuer_family_filter", "A9", """
SELECT cert_hash, issuer_dn FROM certificates
WHERE contains(lower(issuer_dn), 'building') OR contains(lower(issuer_dn), 'machinery')
""")
def issuer_family_filter(spark, d):
    c = A.certificates(spark, d, columns=["issuer_dn"]).withColumn("issuer_spki_hash", F.lit(None).cast("string"))
    return c.filter(Is.issuer_matches(FAMILY)).select("cert_hash", "issuer_dn")


@register("issuer_key", "A10", "SELECT cert_hash, sha256(issuer_dn) AS issuer_key FROM certificates")
def issuer_key_query(spark, d):
    c = A.certificates(spark, d, columns=["issuer_dn"]).withColumn("issuer_spki_hash", F.lit(None).cast("string"))
    return c.select("cert_hash", Is.issuer_key().alias("issuer_key"))


@register("fingerprint", "A6", "SELECT page_id, sha256(html) AS fingerprint FROM pages")
def fingerprint(spark, d):
    p = A.read_table(spark, d, "pages")
    return p.select("page_id", Is.fingerprint(F.col("html")).alias("fingerprint"))


@register("certificates_latest", "A13", """
SELECT cert_hash, last_seen, ingest_seq, anomaly_score, validity_days FROM certificates
""")
def certificates_latest(spark, d):
    return A.certificates(spark, d, columns=["last_seen", "ingest_seq", "anomaly_score", "validity_days"])


@register("batch_dedupe", "A12", """
SELECT batch_day, cert_hash, last_seen, ingest_seq, anomaly_score FROM (
  SELECT CAST(last_seen AS DATE) AS batch_day, cert_hash, last_seen, ingest_seq, anomaly_score,
         row_number() OVER (PARTITION BY CAST(last_seen AS DATE), cert_hash
                            ORDER BY last_seen DESC, ingest_seq DESC) AS rn
  FROM certificate_versions) t
WHERE rn = 1
""")
def batch_dedupe(spark, d):
    v = A.certificate_versions(spark, d).withColumn("batch_day", F.to_date("last_seen"))
    return Lt.latest_by(v, ["batch_day", "cert_hash"], ["last_seen", "ingest_seq"],
                        ["batch_day", "cert_hash", "last_seen", "ingest_seq", "anomaly_score"])


@register("retention", "A18", f"""
SELECT seen_at, cert_hash, registered_domain, issuer_key, log_id FROM observations
WHERE {O.trailing('seen_at', RETENTION_DAYS)}
""")
def retention(spark, d):
    return Lt.retained(A.observations(spark, d), AS_OF, RETENTION_DAYS).select(
        "seen_at", "cert_hash", "registered_domain", "issuer_key", "log_id")


@register("hostname_unicode", "B5", f"""
SELECT DISTINCT host,
       CASE WHEN contains({O.norm_sql('host')}, 'xn--') THEN NULL ELSE {O.norm_sql('host')} END AS unicode_hostname,
       FALSE AS has_confusable
FROM hosts WHERE host IS NOT NULL
""")
def hostname_unicode(spark, d):
    from certlens.functions.unicode import host_idna_table
    t = host_idna_table(A.hosts(spark, d), "host")
    return t.select("host", "unicode_hostname", F.col("confusable_json").isNotNull().alias("has_confusable"))


_A8_COLS = ["subject_cn", "subject_dn", "subject_org", "issuer_cn", "issuer_dn", "serial_number", "not_before",
            "dns_names", "san_count", "validity_days", "key_type", "key_size", "sig_alg", "eku", "key_usage",
            "basic_constraints_ca", "policy_oids", "aia_ocsp_urls", "validation_type", "has_ip_san",
            "has_must_staple", "subject_dn_length", "issuer_dn_length"]


@register("certificate_features", "A8", """
, x AS (
  SELECT c_custkey AS k, c_name, c_mktsegment AS seg, c_nationkey AS nk, c_acctbal,
         CAST(c_custkey % 20 AS VARCHAR) AS site,
         CASE WHEN c_custkey % 2 = 0 THEN 'Org ' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS org
  FROM customer),
f AS (
  SELECT k AS c_custkey, c_name AS subject_cn,
         CASE WHEN org <> '' THEN 'O=' || org || ',CN=' || c_name ELSE 'CN=' || c_name END AS subject_dn,
         org AS subject_org, seg || ' CA' AS issuer_cn, 'CN=' || seg || ' CA,O=' || seg || ' Trust,C=US' AS issuer_dn,
         '0x' || lower(hex(k + 1)) AS serial_number,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k % 28 AS INTEGER)) AS not_before,
         ['www.site' || site || '.example', 'login.site' || site || '.example'] AS dns_names, 2 AS san_count,
         CAST(floor(abs(c_acctbal) / 12) AS INTEGER) AS validity_days,
         CASE k % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'RSA' WHEN 2 THEN 'ECDSA' ELSE 'Ed25519' END AS key_type,
         CASE k % 4 WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 256 END AS key_size,
         CASE k % 5 WHEN 0 THEN 'SHA1' WHEN 1 THEN 'SHA384' ELSE 'SHA256' END AS sig_alg,
         CASE k % 4 WHEN 0 THEN ['serverAuth'] WHEN 1 THEN ['serverAuth', 'clientAuth'] WHEN 2 THEN ['emailProtection']
              ELSE ['clientAuth', 'serverAuth'] END AS eku,
         CASE WHEN k % 29 = 0 THEN ['digitalSignature', 'keyEncipherment', 'keyCertSign']
              ELSE ['digitalSignature', 'keyEncipherment'] END AS key_usage,
         CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS basic_constraints_ca,
         CASE k % 5 WHEN 0 THEN ['2.23.140.1.1'] WHEN 1 THEN ['2.23.140.1.2.2'] WHEN 2 THEN ['2.23.140.1.2.1']
              WHEN 3 THEN ['2.23.140.1.2.1', '2.23.140.1.2.2'] ELSE ['1.3.6.1.4.1'] END AS policy_oids,
         CASE WHEN k % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['http://ocsp' || site || '.example'] END AS aia_ocsp_urls,
         CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS has_ip_san,
         CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS has_must_staple
  FROM x)
SELECT *, CASE WHEN list_contains(policy_oids, '2.23.140.1.1') THEN 'EV'
               WHEN list_contains(policy_oids, '2.23.140.1.2.2') THEN 'OV'
               WHEN list_contains(policy_oids, '2.23.140.1.2.1') THEN 'DV' ELSE 'Unknown' END AS validation_type,
       length(subject_dn) AS subject_dn_length, length(issuer_dn) AS issuer_dn_length
FROM f
""")
def certificate_features(spark, d):
    from certlens.operators.features import extract_features
    from certlens.sources.dersynth import customer_certificates
    ders = customer_certificates(A.read_table(spark, d, "customer"))
    keyed = ders.select("c_custkey", F.sha2("der", 256).alias("cert_hash"))
    good, _ = extract_features(ders.select("der"))
    # Not broadcast: Spark estimates both sides from the customer table's compressed size.
    return keyed.hint("merge").join(good, "cert_hash").select(
        "c_custkey", *[F.col(c).cast("timestamp_ntz").alias(c) if c == "not_before" else F.col(c)
                       for c in _A8_COLS])
