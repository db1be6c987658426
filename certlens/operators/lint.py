"""Lint rules (C): one declarative list of (code, severity, condition,
evidence); evaluated as an array of optional structs and exploded, so all
15 rules run in one projection inside whole-stage codegen.

Input: certificates with ``attach_name_features`` columns (domain_tokens,
name_info). Evidence objects are JSON with alphabetically ordered keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.config import (BRAND_KEYWORDS, CA_KEY_USAGES, DEFAULT, DEPRECATED_SIG_ALGS, Settings,
                             SUSPICIOUS_DN_PATTERN)
from certlens.functions import certcols
from certlens.functions.timewin import ts_lit

def _json(**fields: Column) -> Column:
    """to_json over a struct whose fields are sorted by name."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def with_rule_inputs(df: DataFrame) -> DataFrame:
    """Precompute the terms several rules share (organisation-vs-domain sets,
    first confusable name) in their own projection, so each is evaluated
    once per row instead of once per reference."""
    out = df.withColumns({"_org": F.array_sort(F.array_distinct(F.col("org_tokens"))),
                          "_conf": first_confusable(10)})
    return out.withColumns({
        "_brands": F.array_sort(F.array_intersect(F.col("_org"), F.array(*[F.lit(b) for b in BRAND_KEYWORDS]))),
        "_disjoint": F.size(F.array_intersect(F.col("_org"), F.col("domain_tokens"))) == 0})


def org_columns() -> dict[str, Column]:
    """Shared organisation-vs-domain terms (see ``with_rule_inputs``)."""
    return {"org": F.col("_org"), "dom": F.col("domain_tokens"), "brands": F.col("_brands"),
            "disjoint": F.col("_disjoint")}


def with_org_tokens(certs: DataFrame) -> DataFrame:
    """Organisation tokens of subject_org (ASCII JVM-side, else NFKD UDF)."""
    from certlens.functions.unicode import with_organization_tokens
    return with_organization_tokens(certs, "subject_org", "org_tokens")


def first_confusable(limit: int = 10) -> Column:
    """Evidence JSON of the first confusable name among the first ``limit``."""
    hits = F.filter(F.slice(F.col("name_info"), 1, limit), lambda x: x["confusable_json"].isNotNull())
    return F.try_element_at(F.transform(hits, lambda x: x["confusable_json"]), F.lit(1))


def lint_rules(settings: Settings = DEFAULT) -> list[tuple[str, Column, Column, Column]]:
    t = settings.thresholds
    c = F.col
    o = org_columns()
    ovev = c("validation_type").isin("OV", "EV")
    org_sev = F.when(ovev, "medium").otherwise("low")
    present_ca_bits = F.array_sort(F.array_intersect(F.array(*[F.lit(x) for x in CA_KEY_USAGES]), c("key_usage")))
    has_org = c("subject_org") != ""
    conf = F.col("_conf")
    return [
        ("SAN_MISSING", F.lit("high"), c("san_count") == 0, _json(subject_cn=c("subject_cn"))),
        ("CN_NOT_IN_SAN", F.lit("info"), (c("subject_cn") != "") & ~F.array_contains(c("dns_names"), c("subject_cn")),
         _json(subject_cn=c("subject_cn"), dns_names=F.slice(c("dns_names"), 1, 5))),
        ("RSA_KEY_TOO_SMALL", F.lit("high"), (c("key_type") == "RSA") & (c("key_size") < 2048),
         _json(key_size=c("key_size"))),
        ("DEPRECATED_SIG_ALGORITHM", F.lit("high"), F.upper(c("sig_alg")).isin(*DEPRECATED_SIG_ALGS),
         _json(sig_alg=c("sig_alg"))),
        ("VALIDITY_TOO_LONG", F.lit("high"), c("validity_days") > t.high_validity_days,
         _json(validity_days=c("validity_days"))),
        ("VALIDITY_LONG", F.lit("medium"),
         (c("validity_days") <= t.high_validity_days) & (c("validity_days") > t.medium_validity_days),
         _json(validity_days=c("validity_days"))),
        ("EKU_MISSING_SERVER_AUTH", F.lit("medium"), certcols.unusual_eku("eku"), _json(eku=c("eku"))),
        ("LEAF_MARKED_CA", F.lit("high"), c("basic_constraints_ca") != 0,
         _json(basic_constraints_ca=c("basic_constraints_ca"))),
        ("LEAF_KEY_USAGE_CA_BITS", F.lit("high"), F.size(present_ca_bits) > 0, _json(key_usage=present_ca_bits)),
        ("DN_NON_ASCII", F.lit("low"), (c("subject_has_non_ascii") != 0) | (c("issuer_has_non_ascii") != 0),
         _json(subject_has_non_ascii=c("subject_has_non_ascii"), issuer_has_non_ascii=c("issuer_has_non_ascii"))),
        ("DN_SUSPICIOUS_FORMATTING", F.lit("medium"),
         c("subject_dn").rlike("(?U)" + SUSPICIOUS_DN_PATTERN) | c("issuer_dn").rlike("(?U)" + SUSPICIOUS_DN_PATTERN),
         _json(subject_dn=c("subject_dn"), issuer_dn=c("issuer_dn"))),
        ("AIA_OCSP_MISSING", F.lit("info"), F.size(c("aia_ocsp_urls")) == 0, F.lit("{}")),
        ("ORG_BRAND_IMPERSONATION", org_sev, has_org & (F.size(o["brands"]) > 0) & o["disjoint"],
         _json(subject_org=c("subject_org"), brand_matches=o["brands"], domain_tokens=o["dom"],
               validation_type=c("validation_type"))),
        ("ORG_DOMAIN_MISMATCH", org_sev,
         has_org & (F.size(o["org"]) > 0) & (F.size(o["dom"]) > 0) & o["disjoint"],
         _json(subject_org=c("subject_org"), org_tokens=o["org"], domain_tokens=o["dom"],
               validation_type=c("validation_type"))),
        ("IDN_CONFUSABLE", F.lit("medium"), conf.isNotNull(), conf),
    ]


def lint_findings(certs: DataFrame, created_at, settings: Settings = DEFAULT) -> DataFrame:
    """Findings of all lint rules; ``certs`` needs the name features and
    ``org_tokens`` (see ``with_org_tokens``)."""
    items = F.array(*[F.when(cond, F.struct(F.lit(code).alias("finding_code"), sev.alias("severity"),
                                             ev.alias("evidence_json")))
                      for code, sev, cond, ev in lint_rules(settings)])
    out = with_rule_inputs(certs).select("cert_hash", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("f"))
    stamp = ts_lit(created_at) if created_at is not None else F.current_timestamp()
    return out.select("cert_hash", "f.finding_code", "f.severity", "f.evidence_json", stamp.alias("created_at"))


__all__ = ["lint_findings", "lint_rules", "with_org_tokens", "with_rule_inputs"]
