"""Host-name column expressions, all JVM-side (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certlens.config import SUSPICIOUS_KEYWORDS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``.

    Spark does not share common subexpressions inside higher-order-function
    lambdas, so an expression referenced several times in a lambda would be
    re-evaluated each time; binding it through a one-element array avoids it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_hostname(host: Column | str) -> Column:
    """Strip surrounding white space, lower-case, drop all trailing dots."""
    trimmed = F.regexp_replace(_c(host), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.regexp_replace(F.lower(trimmed), r"\.+$", "")


def strip_wildcard(host_norm: Column) -> Column:
    """Remove one leading '*.' (registered-domain input form)."""
    return F.when(host_norm.startswith("*."), F.substring(host_norm, 3, 1 << 30)).otherwise(host_norm)


def domain_labels(host: Column | str) -> Column:
    """Non-empty labels after removing leading '*' and '.' characters."""
    value = F.regexp_replace(normalize_hostname(host), r"^[*.]+", "")
    return F.filter(F.split(value, r"\."), lambda x: x != "")


def tokenize_domain(host: Column | str) -> Column:
    """All label suffixes, longest first: a.b.c -> [a.b.c, b.c, c]."""
    def suffixes(parts):
        n = F.size(parts)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))
    return let(domain_labels(host), suffixes)


def has_punycode(host: Column | str) -> Column:
    return normalize_hostname(host).contains("xn--")


def shannon_entropy(value: Column | str) -> Column:
    """Shannon entropy in bits per character (0.0 for the empty string)."""
    def entropy(chars):
        n = F.size(chars).cast("double")

        def term(acc, ch):
            p = F.size(F.filter(chars, lambda x: x == ch)).cast("double") / n
            return acc - p * F.log2(p)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), term)

    s = _c(value)
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(let(F.split(s, ""), entropy))


def highest_label_entropy(host: Column | str) -> Column:
    """Max entropy over labels that are entirely [a-z0-9-]; 0.0 when none."""
    labels = F.filter(F.split(normalize_hostname(host), r"\."), lambda x: x.rlike(r"^[a-z0-9-]+$"))
    return F.coalesce(F.array_max(F.transform(labels, shannon_entropy)), F.lit(0.0))


def suspicious_keywords(host: Column | str, keywords=SUSPICIOUS_KEYWORDS) -> Column:
    """Keywords (in configured order) that occur in the normalised host."""
    kws = F.array(*[F.lit(k.lower()) for k in keywords]) if keywords else F.array().cast("array<string>")
    return let(normalize_hostname(host), lambda norm: F.filter(kws, lambda k: norm.contains(k)))


_IPV4 = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_IPV4}(\.{_IPV4}){{3}}$"
_H = r"[0-9a-fA-F]{1,4}"
IPV6_PATTERN = (
    r"^(("
    rf"({_H}:){{7}}{_H}|"
    rf"({_H}:){{1,7}}:|"
    rf"({_H}:){{1,6}}:{_H}|"
    rf"({_H}:){{1,5}}(:{_H}){{1,2}}|"
    rf"({_H}:){{1,4}}(:{_H}){{1,3}}|"
    rf"({_H}:){{1,3}}(:{_H}){{1,4}}|"
    rf"({_H}:){{1,2}}(:{_H}){{1,5}}|"
    rf"{_H}:(:{_H}){{1,6}}|"
    rf":((:{_H}){{1,7}}|:)"
    rf")|(({_H}:){{6}}|::({_H}:){{0,5}}|({_H}:){{1,5}}:)" + IPV4_PATTERN[1:-1] + r")$"
)


def is_ip_literal(value: Column | str) -> Column:
    v = _c(value)
    return v.rlike(IPV4_PATTERN) | v.rlike(IPV6_PATTERN)
