"""Table schemas and the additive ``conform`` used for schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
TS, D = T.TimestampType(), T.DateType()
ARR = T.ArrayType(T.StringType())


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


CERTIFICATES = T.StructType([
    _f("cert_hash", S), _f("subject_cn", S), _f("subject_dn", S), _f("subject_org", S),
    _f("issuer_cn", S), _f("issuer_dn", S), _f("issuer_spki_hash", S, True),
    _f("serial_number", S), _f("not_before", TS, True), _f("not_after", TS, True),
    _f("dns_names", ARR), _f("san_count", I), _f("has_wildcard", I), _f("has_punycode", I),
    _f("validity_days", I), _f("key_type", S), _f("key_size", I), _f("sig_alg", S),
    _f("eku", ARR), _f("key_usage", ARR), _f("basic_constraints_ca", I),
    _f("ski", S, True), _f("aki", S, True), _f("policy_oids", ARR),
    _f("aia_ocsp_urls", ARR), _f("crl_dp_urls", ARR), _f("validation_type", S),
    _f("has_must_staple", I), _f("has_ip_san", I), _f("has_uri_san", I), _f("has_email_san", I),
    _f("subject_has_non_ascii", I), _f("issuer_has_non_ascii", I),
    _f("subject_dn_length", I), _f("issuer_dn_length", I),
    _f("first_seen", TS, True), _f("last_seen", TS, True), _f("anomaly_score", I),
])

# Stored versions carry a monotonically increasing ingest sequence as the
# tie-break between two versions with the same last_seen.
CERTIFICATE_VERSIONS = T.StructType(CERTIFICATES.fields + [_f("ingest_seq", L)])

OBSERVATIONS = T.StructType([
    _f("seen_at", TS, True), _f("cert_hash", S), _f("registered_domain", S),
    _f("issuer_key", S), _f("log_id", S), _f("source", S), _f("domain_tokens", ARR),
])

FINDINGS = T.StructType([
    _f("cert_hash", S), _f("finding_code", S), _f("severity", S),
    _f("evidence_json", S), _f("created_at", TS, True),
])

ISSUER_DAILY_STATS = T.StructType([
    _f("day", D), _f("issuer_key", S), _f("cert_count", L), _f("domain_count", L),
    _f("wildcard_count", L), _f("punycode_count", L), _f("ip_san_count", L),
    _f("uri_san_count", L), _f("email_san_count", L), _f("unusual_eku_count", L),
    _f("ca_true_leaf_count", L), _f("updated_at", TS, True),
])

ISSUER_SIGALG_STATS = T.StructType([
    _f("day", D), _f("issuer_key", S), _f("sig_alg", S), _f("count", L), _f("updated_at", TS, True),
])

DASHBOARD_SNAPSHOTS = T.StructType([_f("days", I), _f("payload_json", S), _f("updated_at", TS, True)])

TABLES = {
    "certificates": CERTIFICATE_VERSIONS,
    "observations": OBSERVATIONS,
    "cert_findings": FINDINGS,
    "issuer_daily_stats": ISSUER_DAILY_STATS,
    "issuer_sigalg_stats": ISSUER_SIGALG_STATS,
    "dashboard_snapshots": DASHBOARD_SNAPSHOTS,
}

# Column defaults applied when an older table lacks a column.
_DEFAULTS = {
    "source": "certstream",
}


def _default(field: T.StructField):
    if field.name in _DEFAULTS:
        return F.lit(_DEFAULTS[field.name])
    dt = field.dataType
    if isinstance(dt, T.ArrayType):
        return F.array().cast(dt)
    if isinstance(dt, T.StringType):
        return F.lit(None).cast(dt) if field.nullable else F.lit("")
    if isinstance(dt, (T.IntegerType, T.LongType)):
        return F.lit(0).cast(dt)
    return F.lit(None).cast(dt)


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Add missing columns with their defaults and order columns as in ``schema``.

    Existing columns keep their values; integer-like flags are cast to the
    target type. Timestamp columns keep their type (with or without time
    zone) so that reads of driver data need no conversion.
    """
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            c = F.col(field.name)
            if isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.ArrayType)):
                c = c.cast(field.dataType)
            cols.append(c.alias(field.name))
        else:
            cols.append(_default(field).alias(field.name))
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols)
