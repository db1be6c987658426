"""Adapters: give the engine certificate-shaped tables over the driver tables.

The driver ships generic tables (``events``, ``customer``, ``pages``). These
functions derive the engine's tables from them exactly as the adapter views
in FIXTURES.md do, so that DuckDB can run the same definitions as plain SQL.
All derivations are narrow projections / one equi-join: they scale with the
input and keep predicate pushdown into the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.functions import certcols
from certlens.operators.latest import latest_versions
from certlens.schemas import CERTIFICATE_VERSIONS, conform
from certlens.session import ship_package
from certlens.sources import store

# Fixed query time for the driver data (events cover 2024-01-01 .. 2024-01-30).
AS_OF = "2024-01-31 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # All engine time semantics are UTC (timestamps, day buckets, epochs).
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)  # Python workers (UDFs) import certlens
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "*",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        (F.col("user_id") * 5 + F.col("event_id") % 5).alias("cert_no"),
    )


def _cert_hash(no) -> F.Column:
    return F.concat(F.lit("cert-"), no.cast("string"))


def derive_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev(spark, sf_dir)
    k = F.col("k")
    return e.select(
        F.col("ts").alias("seen_at"),
        _cert_hash(F.col("cert_no")).alias("cert_hash"),
        F.when(k % 20 == 0, F.lit("")).otherwise(
            F.concat(F.lit("site"), (k % 20).cast("string"), F.lit(".example"))).alias("registered_domain"),
        F.concat(F.lit("issuer-"), (F.col("cert_no") % 3).cast("string")).alias("issuer_key"),
        F.col("event_type").alias("log_id"),
        F.lit("certstream").alias("source"),
        F.array().cast("array<string>").alias("domain_tokens"),
    )


def derive_certificate_versions(spark: SparkSession, sf_dir: str, full_schema: bool = False) -> DataFrame:
    """One certificate version per event (``ingest_seq`` = event id)."""
    e = ev(spark, sf_dir).select("event_id", "ts", "value", "cert_no")
    c = read_table(spark, sf_dir, "customer")
    j = e.join(c, c.c_custkey == e.cert_no, "inner")
    key = F.col("c_custkey")
    site = (key % 20).cast("string")
    df = j.select(
        _cert_hash(key).alias("cert_hash"),
        F.col("c_name").alias("subject_cn"),
        F.col("c_mktsegment").alias("issuer_cn"),
        F.concat(F.lit("CN="), F.col("c_mktsegment")).alias("issuer_dn"),
        F.concat(F.lit("issuer-"), (key % 3).cast("string")).alias("issuer_key"),
        F.split(F.concat(F.lit("www.site"), site, F.lit(".example,login.site"), site, F.lit(".example")), ",")
        .alias("dns_names"),
        (F.col("c_nationkey") + key % 3).cast("int").alias("san_count"),
        F.floor(F.abs(F.col("c_acctbal")) / 12).cast("int").alias("validity_days"),
        F.when(key % 3 == 0, "RSA").when(key % 3 == 1, "ECDSA").otherwise("Ed25519").alias("key_type"),
        F.when(key % 4 == 0, 1024).when(key % 4 == 1, 2048).when(key % 4 == 2, 4096).otherwise(256)
        .alias("key_size"),
        F.when(key % 5 == 0, "SHA1").when(key % 5 == 1, "SHA384").otherwise("SHA256").alias("sig_alg"),
        F.split(F.when(key % 4 == 0, "serverAuth").when(key % 4 == 1, "serverAuth,clientAuth")
                .when(key % 4 == 2, "emailProtection").otherwise("clientAuth,serverAuth"), ",").alias("eku"),
        F.split(F.when(key % 5 == 0, "2.23.140.1.1").when(key % 5 == 1, "2.23.140.1.2.2")
                .when(key % 5 == 2, "2.23.140.1.2.1").when(key % 5 == 3, "2.23.140.1.2.1,2.23.140.1.2.2")
                .otherwise("1.3.6.1.4.1"), ",").alias("policy_oids"),
        (key % 7 == 0).cast("int").alias("has_wildcard"),
        (key % 11 == 0).cast("int").alias("has_punycode"),
        (key % 13 == 0).cast("int").alias("has_ip_san"),
        (key % 17 == 0).cast("int").alias("has_uri_san"),
        (key % 19 == 0).cast("int").alias("has_email_san"),
        (key % 23 == 0).cast("int").alias("has_must_staple"),
        (key % 29 == 0).cast("int").alias("basic_constraints_ca"),
        F.col("ts").alias("last_seen"),
        F.col("event_id").alias("ingest_seq"),
        (F.floor("value").cast("int") % 101).cast("int").alias("anomaly_score"),
    )
    if full_schema:
        df = (conform(df, CERTIFICATE_VERSIONS, keep_extra=True)
              .withColumn("validation_type", certcols.validation_type("policy_oids"))
              .withColumn("issuer_has_non_ascii", certcols.has_non_ascii("issuer_dn"))
              .withColumn("subject_has_non_ascii", certcols.has_non_ascii("subject_dn"))
              .withColumn("issuer_dn_length", F.length("issuer_dn"))
              .withColumn("subject_dn_length", F.length("subject_dn"))
              .withColumn("first_seen", F.col("last_seen")))
    return df


def derive_certificates(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
                        full_schema: bool = False) -> DataFrame:
    """Latest version per certificate, derived directly (no stored table)."""
    return latest_versions(derive_certificate_versions(spark, sf_dir, full_schema), columns=columns)


def derive_cert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error"))
    k = F.col("k")
    purchase = F.col("event_type") == "purchase"
    score = (F.floor("value").cast("int") % 101).cast("int")
    return e.select(
        _cert_hash(F.col("cert_no")).alias("cert_hash"),
        F.when(purchase, "ANOMALY_SCORE").when(k % 3 == 0, "VALIDITY_LONG")
        .when(k % 3 == 1, "SAN_MISSING").otherwise("CN_NOT_IN_SAN").alias("finding_code"),
        F.when(purchase, "info").when(k % 3 == 0, "medium").when(k % 3 == 1, "high").otherwise("info")
        .alias("severity"),
        F.concat(F.lit('{"anomaly_score": '), score.cast("string"), F.lit(', "top_signals": []}'))
        .alias("evidence_json"),
        F.col("ts").alias("created_at"),
    )


def lint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External-linter output per event, derived from ``events``:
    (cert_hash, result_json) with one object-form and one bare-status result."""
    e = ev(spark, sf_dir)
    k = F.col("k")
    s1 = (F.when(k % 5 == 0, "pass").when(k % 5 == 1, "warn").when(k % 5 == 2, "error")
          .when(k % 5 == 3, "notice").otherwise("NA"))
    s2 = F.when(k % 4 == 0, "info").when(k % 4 == 1, "fatal").when(k % 4 == 2, "ne").otherwise("bogus")
    js = F.concat(F.lit('{"results": {"e_'), F.col("event_type"), F.lit('_rule": {"result": "'), s1,
                  F.lit('", "details": "k='), k.cast("string"), F.lit('", "source": "RFC 5280"}, "n_value.'),
                  (k % 7).cast("string"), F.lit('": "'), s2, F.lit('"}}'))
    return e.select(_cert_hash(F.col("cert_no")).alias("cert_hash"), js.alias("result_json"))


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificate-stream JSON messages derived from ``events`` (event_id, value).
    Three event types are certificate updates; the leaf is ``as_der`` (the
    base64 of ``props``) or, when that is empty, ``der`` (base64 of the type)."""
    e = ev(spark, sf_dir)
    k = F.col("k")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = F.concat((micros / 1_000_000).cast("long").cast("string"), F.lit("."),
                    F.lpad((micros % 1_000_000).cast("string"), 6, "0"))
    b64 = lambda c: F.base64(c.cast("binary"))
    value = F.concat(
        F.lit('{"message_type": "'),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "certificate_update").otherwise("heartbeat"),
        F.lit('", "data": {"leaf_cert": {"as_der": "'), F.when(k % 10 == 0, F.lit("")).otherwise(b64(F.col("props"))),
        F.lit('", "der": "'), b64(F.col("event_type")),
        F.lit('"}, "chain": [{"as_der": ""}, {"cert": "'), b64(F.col("user_id").cast("string")),
        F.lit('"}], "seen": '), seen,
        F.lit(', "source": {"name": "'), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("log-"), (k % 3).cast("string"))),
        F.lit('", "url": "https://ct.example/'), (k % 2).cast("string"), F.lit('"}}}'))
    return e.select("event_id", value.alias("value"))


def der_messages(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Certificate-update messages carrying real DER: one per event, the leaf
    is the certificate encoded from the event's customer row, the chain holds
    the certificate of customer ``cert_no % 3`` (its key is the issuer key).

    ``broken``: errors' leaves are not base64, signups have none, and clicks with
    ``k`` divisible by 10 have bytes that are no certificate."""
    from certlens.sources.dersynth import customer_certificates

    customers = read_table(spark, sf_dir, "customer")
    e = ev(spark, sf_dir).select("event_id", "ts", "event_type", "cert_no", "k", "props")
    # base64 may be MIME-chunked with line breaks; JSON text needs one line.
    b64 = F.regexp_replace(F.base64("der"), r"\s", "")
    leaf = customer_certificates(customers).select(F.col("c_custkey").alias("cert_no"), b64.alias("leaf"))
    issuers = customers.filter(F.col("c_custkey").between(-2, 2))  # remainders by 3
    chain = customer_certificates(issuers).select(F.col("c_custkey").alias("issuer_no"), b64.alias("chain"))
    # Never broadcast the leaves: a certificate is many times as large as the customer row
    # that Spark's size estimate is taken from.
    j = e.join(leaf.hint("merge"), "cert_no").withColumn("issuer_no", F.col("cert_no") % 3).join(F.broadcast(chain), "issuer_no")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = F.concat((micros / 1_000_000).cast("long").cast("string"), F.lit("."),
                    F.lpad((micros % 1_000_000).cast("string"), 6, "0"))
    text = F.col("leaf")
    if broken:
        text = (F.when(F.col("event_type") == "error", "%%%").when(F.col("event_type") == "signup", "")
                .when((F.col("event_type") == "click") & (F.col("k") % 10 == 0), F.base64(F.col("props").cast("binary"))).otherwise(text))
    value = F.concat(F.lit('{"message_type": "certificate_update", "data": {"leaf_cert": {"as_der": "'),
                     text, F.lit('"}, "chain": [{"as_der": "'), F.col("chain"),
                     F.lit('"}], "seen": '), seen, F.lit(', "source": {"name": "'), F.col("event_type"),
                     F.lit('"}}}'))
    return j.select("event_id", value.alias("value"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "https?://([^/:?#]+)", 1).alias("host"))


# ---- stored-table accessors (what reports read) ---------------------------

def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored observations (partitioned by ``seen_day``)."""
    return store.read(spark, sf_dir, "observations")


def certificate_versions(spark: SparkSession, sf_dir: str, full_schema: bool = False) -> DataFrame:
    """Stored certificate versions (full schema plus issuer_key, ingest_seq)."""
    return store.read(spark, sf_dir, "certificate_versions")


def certificates(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
                 full_schema: bool = False) -> DataFrame:
    """Stored latest certificates (one row per cert_hash)."""
    df = store.read(spark, sf_dir, "certificates")
    if columns is not None:
        df = df.select("cert_hash", *[c for c in columns if c != "cert_hash"])
    return df


def cert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, sf_dir, "cert_findings")


@dataclass
class CertTables:
    """The three base tables a report reads."""

    observations: DataFrame
    certificates: DataFrame
    findings: DataFrame


def tables(spark: SparkSession, sf_dir: str) -> CertTables:
    return CertTables(observations(spark, sf_dir), certificates(spark, sf_dir), cert_findings(spark, sf_dir))


#: Classes of ``rule_case_certificates``.
RULE_CASES = 16


def rule_case_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest certificates with the fields that rules read set by the class of their
    number (``cert_no % 16``), so that every lint rule and every signal has certificates
    that it fires for, and others that it does not. Class 0 is clean; each other one
    differs from it in the fields below alone. Columns ``cert_no`` and ``case``."""
    certs = certificates(spark, sf_dir).withColumn("cert_no", F.regexp_extract("cert_hash", "([0-9]+)$", 1).cast("long"))
    certs = certs.withColumn("case", (F.col("cert_no") % RULE_CASES).cast("int"))
    texts = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    host, idn, busy = "host.plain.example", "www.xn--ellraboutique-dnb.com", "login.burst.example"
    entropic, both = "a9x3kq7zw2m5b8.plain.example", "a9x3kq7zw2m5b8.xn--ellraboutique-dnb.com"
    clean = {
        "subject_cn": F.lit(host), "subject_dn": F.lit(f"CN={host}"), "subject_org": F.lit(""), "issuer_dn": F.lit("CN=Plain"), "issuer_key": F.lit("quiet"), "dns_names": texts(host),
        "san_count": F.lit(1), "key_type": F.lit("RSA"), "key_size": F.lit(2048), "sig_alg": F.lit("SHA256"), "validity_days": F.lit(90), "eku": texts("serverAuth"),
        "key_usage": texts("digitalSignature"), "basic_constraints_ca": F.lit(0), "aia_ocsp_urls": texts("http://ocsp.plain.example"), "validation_type": F.lit("DV"),
        **{c: F.lit(0) for c in ("has_wildcard", "has_punycode", "has_ip_san", "has_uri_san", "has_email_san", "subject_has_non_ascii", "issuer_has_non_ascii")},
    }
    cases: dict[int, dict] = {
        1: {"dns_names": texts(), "san_count": F.lit(0), "subject_cn": F.lit("")},
        2: {"subject_cn": F.lit("other.plain.example")},
        3: {"key_size": F.lit(1024), "sig_alg": F.lit("sha1")},
        4: {"validity_days": F.lit(900)},
        5: {"validity_days": F.lit(400), "issuer_key": F.lit("unknown")},
        6: {"eku": texts("emailProtection")},
        7: {"basic_constraints_ca": F.lit(1), "key_usage": texts("keyCertSign", "digitalSignature")},
        8: {"subject_dn": F.lit("CN=höst.plain.example"), "subject_has_non_ascii": F.lit(1)},
        9: {"subject_dn": F.lit("CN=a,,O=b")},
        10: {"aia_ocsp_urls": texts()},
        11: {"subject_org": F.lit("Microsoft Corporation"), "validation_type": F.lit("OV")},
        12: {"dns_names": texts(idn), "subject_cn": F.lit(idn), "has_punycode": F.lit(1)},
        13: {"dns_names": texts(entropic), "subject_cn": F.lit(entropic)},
        14: {"dns_names": texts(both), "subject_cn": F.lit(both), "has_punycode": F.lit(1)},
        15: {"dns_names": texts(busy), "subject_cn": F.lit(busy), "san_count": F.lit(30), "has_wildcard": F.lit(1), "has_ip_san": F.lit(1), "issuer_key": F.lit("spiking")},
    }
    changed = {}
    for column, value in clean.items():
        for case, fields in cases.items():
            if column in fields:
                value = F.when(F.col("case") == case, fields[column]).otherwise(value)
        changed[column] = value
    return certs.withColumns(changed)
