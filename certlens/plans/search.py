"""Lookups and search.

Certificate predicates are applied to the certificate side before the join
and observations are collapsed to one row per certificate (max seen_at, a
deterministic domain) *before* joining, so the join sees one row per
certificate instead of one per sighting.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.functions import certcols
from certlens.functions.timewin import Span
from certlens.functions.unicode import with_unicode_names

SCORE = "ANOMALY_SCORE"


def certificate_detail(certificates: DataFrame, cert_hash: str) -> DataFrame:
    """The latest row of one certificate, validation type recomputed from
    its policy OIDs and decoded DNS names (empty result = not found)."""
    c = (certificates.filter(F.col("cert_hash") == cert_hash)
         .withColumn("validation_type", certcols.validation_type("policy_oids")))
    return with_unicode_names(c, "dns_names", "dns_names_unicode", "cert_hash")


def certificate_findings(findings: DataFrame, cert_hash: str, limit: int = 100) -> DataFrame:
    """Newest ``limit`` findings of one certificate."""
    return (findings.filter(F.col("cert_hash") == cert_hash)
            .select("finding_code", "severity", "evidence_json", "created_at")
            .orderBy(F.desc("created_at"), F.asc("finding_code"), F.asc("severity"), F.asc("evidence_json"))
            .limit(limit))


@dataclass
class SearchFilters:
    """Optional predicates; ``None`` or '' means "no filter"."""

    registered_domain: str | None = None
    validation_type: str | None = None
    subject_cn_contains: str | None = None
    issuer_contains: str | None = None
    eku_contains: str | None = None
    finding_code: str | None = None
    finding_code_contains: str | None = None
    has_wildcard: bool | None = None
    has_punycode: bool | None = None
    min_validity_days: int | None = None
    max_validity_days: int | None = None
    min_anomaly_score: int | None = None

    def active(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if getattr(self, f.name) is not None and getattr(self, f.name) != ""}


def _icontains(col: Column, needle: str) -> Column:
    return F.lower(col).contains(needle.lower())


def _cert_predicates(f: SearchFilters) -> list[Column]:
    a = f.active()
    preds = []
    if "validation_type" in a:
        preds.append(certcols.validation_type("policy_oids") == a["validation_type"])
    if "subject_cn_contains" in a:
        preds.append(_icontains(F.col("subject_cn"), a["subject_cn_contains"]))
    if "issuer_contains" in a:
        preds.append(_icontains(F.col("issuer_dn"), a["issuer_contains"]))
    if "eku_contains" in a:
        needle = a["eku_contains"].lower()
        preds.append(F.exists("eku", lambda e: F.lower(e).contains(needle)))
    if "has_wildcard" in a:
        preds.append(F.col("has_wildcard") == int(a["has_wildcard"]))
    if "has_punycode" in a:
        preds.append(F.col("has_punycode") == int(a["has_punycode"]))
    if "min_validity_days" in a:
        preds.append(F.col("validity_days") >= a["min_validity_days"])
    if "max_validity_days" in a:
        preds.append(F.col("validity_days") <= a["max_validity_days"])
    if "min_anomaly_score" in a:
        preds.append(F.col("anomaly_score") >= a["min_anomaly_score"])
    return preds


def search_certificates(observations: DataFrame, certificates: DataFrame, findings: DataFrame,
                        span: Span, limit: int, filters: SearchFilters | None = None) -> DataFrame:
    """Certificates observed in ``span`` matching every given predicate;
    newest sighting first, then score. ``registered_domain`` in the output
    is the smallest matching domain (deterministic stand-in for "any")."""
    filters = filters or SearchFilters()
    a = filters.active()
    obs = span.filter(observations, "seen_at")
    if "registered_domain" in a:
        obs = obs.filter(F.col("registered_domain") == a["registered_domain"])
    per_cert = obs.groupBy("cert_hash").agg(F.max("seen_at").alias("last_seen"),
                                            F.min("registered_domain").alias("registered_domain"))
    certs = certificates.select(
        "cert_hash", "subject_cn", "issuer_dn", "dns_names", "eku", "policy_oids", "validity_days",
        "has_wildcard", "has_punycode", "anomaly_score")
    preds = _cert_predicates(filters)
    if preds:
        certs = certs.filter(reduce(lambda x, y: x & y, preds))
    if "finding_code" in a:
        hit = findings.filter(F.col("finding_code") == a["finding_code"]).select("cert_hash")
        certs = certs.join(hit, "cert_hash", "left_semi")
    if "finding_code_contains" in a:
        hit = findings.filter(_icontains(F.col("finding_code"), a["finding_code_contains"])).select("cert_hash")
        certs = certs.join(hit, "cert_hash", "left_semi")
    joined = per_cert.join(certs, "cert_hash")
    return (joined.select(
        "cert_hash", "subject_cn", "issuer_dn", F.slice("dns_names", 1, 10).alias("dns_names"), "eku",
        certcols.validation_type("policy_oids").alias("validation_type"), "validity_days",
        (F.col("has_wildcard") == 1).alias("has_wildcard"), (F.col("has_punycode") == 1).alias("has_punycode"),
        "anomaly_score", "last_seen", "registered_domain")
        .orderBy(F.desc("last_seen"), F.desc("anomaly_score"), F.asc("cert_hash")).limit(limit))


def domain_activity(observations: DataFrame, certificates: DataFrame, findings: DataFrame,
                    registered_domain: str, span: Span, limit: int) -> DataFrame:
    """Sightings of one registered domain, newest first, one row per
    (seen_at, certificate), with the newest anomaly evidence of the cert."""
    obs = (span.filter(observations, "seen_at").filter(F.col("registered_domain") == registered_domain)
           .select("seen_at", "cert_hash").distinct())
    certs = certificates.select("cert_hash", "subject_cn", "dns_names", "anomaly_score", "issuer_dn")
    evidence = (findings.filter(F.col("finding_code") == SCORE)
                .join(obs.select("cert_hash").distinct(), "cert_hash", "left_semi")
                .groupBy("cert_hash").agg(F.max_by("evidence_json", "created_at").alias("anomaly_evidence")))
    rows = obs.join(certs, "cert_hash").join(evidence, "cert_hash", "left")
    return (rows.select(
        "seen_at", "cert_hash", "subject_cn", F.slice("dns_names", 1, 10).alias("dns_names"), "anomaly_score",
        "issuer_dn",
        F.coalesce(F.get_json_object("anomaly_evidence", "$.top_signals"), F.lit("[]")).alias("top_signals_json"))
        .orderBy(F.desc("seen_at"), F.asc("cert_hash")).limit(limit))
