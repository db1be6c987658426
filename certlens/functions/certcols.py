"""Certificate-level column expressions (validation type, EKU keys, buckets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certlens.config import VALIDATION_POLICY_OIDS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def validation_type(policy_oids: Column | str = "policy_oids") -> Column:
    """EV > OV > DV > Unknown, by CA/B Forum policy OID membership."""
    oids = _c(policy_oids)
    expr = F.lit("Unknown")
    for label, oid in reversed(VALIDATION_POLICY_OIDS):
        expr = F.when(F.array_contains(oids, oid), F.lit(label)).otherwise(expr)
    return expr


def eku_key(eku: Column | str = "eku") -> Column:
    """Sorted, comma-joined EKU labels ('' when empty) - the baseline key."""
    return F.array_join(F.array_sort(_c(eku)), ",")


def eku_set(eku: Column | str = "eku") -> Column:
    """Report form of the EKU key: '(none)' for an empty list."""
    e = _c(eku)
    return F.when(F.size(e) == 0, F.lit("(none)")).otherwise(eku_key(e))


def unusual_eku(eku: Column | str = "eku") -> Column:
    """EKU present but without serverAuth."""
    e = _c(eku)
    return (F.size(e) > 0) & ~F.array_contains(e, "serverAuth")


def anomaly_bucket(score: Column | str = "anomaly_score") -> Column:
    s = _c(score)
    return (F.when(s >= 60, "60+").when(s >= 30, "30-59").when(s >= 10, "10-29").otherwise("0-9"))


def validity_bucket(days: Column | str = "validity_days") -> Column:
    d = _c(days)
    return (F.when(d <= 90, "0-90").when(d <= 180, "91-180").when(d <= 397, "181-397").otherwise("398+"))


def san_count_bucket(count: Column | str = "san_count") -> Column:
    # A count of 0 falls into '2-5', as in the original grouping.
    n = _c(count)
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 25, "6-25").otherwise("26+")


def finding_code_label(code: Column | str = "finding_code") -> Column:
    """Display form of a finding code: 'ZLint: ...' for external lints,
    lower case with spaces otherwise, 'none' when empty."""
    c = _c(code)
    plain = F.regexp_replace(F.lower(c), "_", " ")
    external = F.concat(
        F.lit("ZLint: "),
        F.regexp_replace(F.lower(F.regexp_replace(c, "^ZLINT_[A-Z]_", "")), "_", " "),
    )
    return (F.when(c.isNull() | (c == ""), F.lit("none"))
            .when(c.startswith("ZLINT_"), external)
            .otherwise(plain))


def has_non_ascii(value: Column | str) -> Column:
    return _c(value).rlike("[^\\x00-\\x7F]").cast("int")
