"""Certificate feature extraction job.

Each distinct certificate is parsed once: events are reduced to distinct
fingerprints, certificates already known are removed with a left-anti join,
and the DER walk runs in ``mapInPandas`` (Arrow batches) on what is left.
Certificates that fail to parse (or have a non-positive serial) go to a
quarantine output instead of failing the job. Columns that are functions
of other columns (validation type, non-ASCII flags, DN lengths) are added
JVM-side afterwards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certlens.functions import certcols
from certlens.functions.der import parse_certificate
from certlens.session import materialize

S, I, TS, ARR = T.StringType(), T.IntegerType(), T.TimestampType(), T.ArrayType(T.StringType())
PARSED = T.StructType([
    T.StructField("cert_hash", S), T.StructField("subject_cn", S), T.StructField("subject_dn", S),
    T.StructField("subject_org", S), T.StructField("issuer_cn", S), T.StructField("issuer_dn", S),
    T.StructField("serial_number", S), T.StructField("not_before", TS), T.StructField("not_after", TS),
    T.StructField("dns_names", ARR), T.StructField("san_count", I), T.StructField("has_wildcard", I),
    T.StructField("has_punycode", I), T.StructField("validity_days", I), T.StructField("key_type", S),
    T.StructField("key_size", I), T.StructField("sig_alg", S), T.StructField("eku", ARR),
    T.StructField("key_usage", ARR), T.StructField("basic_constraints_ca", I), T.StructField("ski", S),
    T.StructField("aki", S), T.StructField("policy_oids", ARR), T.StructField("aia_ocsp_urls", ARR),
    T.StructField("crl_dp_urls", ARR), T.StructField("has_must_staple", I), T.StructField("has_ip_san", I),
    T.StructField("has_uri_san", I), T.StructField("has_email_san", I), T.StructField("error", S),
])
_NAMES = [f.name for f in PARSED.fields]


def _parse_batches(batches):
    for pdf in batches:
        rows = []
        for cert_hash, der in zip(pdf["cert_hash"], pdf["der"]):
            try:
                row = parse_certificate(bytes(der))
                row["error"] = None
            except Exception as exc:  # noqa: BLE001 - bad input goes to quarantine
                row = dict.fromkeys(_NAMES)
                row["error"] = f"{type(exc).__name__}: {exc}"
            row["cert_hash"] = cert_hash
            rows.append(row)
        yield pd.DataFrame(rows, columns=_NAMES)


def parse_distinct(ders: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cert_hash, der) -> parsed features + ``error`` for every distinct,
    not yet known certificate."""
    distinct = ders.select(F.sha2("der", 256).alias("cert_hash"), "der").dropDuplicates(["cert_hash"])
    if known is not None:
        distinct = distinct.join(known.select("cert_hash"), "cert_hash", "left_anti")
    return distinct.mapInPandas(_parse_batches, PARSED)


def finish_features(parsed: DataFrame) -> DataFrame:
    """Add the columns derived from other columns."""
    return (parsed.withColumn("validation_type", certcols.validation_type("policy_oids"))
            .withColumn("subject_has_non_ascii", certcols.has_non_ascii("subject_dn"))
            .withColumn("issuer_has_non_ascii", certcols.has_non_ascii("issuer_dn"))
            .withColumn("subject_dn_length", F.length("subject_dn"))
            .withColumn("issuer_dn_length", F.length("issuer_dn")))


def extract_features(ders: DataFrame, known: DataFrame | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, quarantine) for the distinct certificates of ``ders``; with
    ``once`` the parsed rows are written to the shared folder first, so that both
    outputs read them instead of parsing again."""
    parsed = parse_distinct(ders, known)
    parsed = materialize(parsed) if once else parsed
    good = finish_features(parsed.filter(F.col("error").isNull()).drop("error"))
    bad = parsed.filter(F.col("error").isNotNull()).select("cert_hash", "error")
    return good, bad
