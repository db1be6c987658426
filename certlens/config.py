"""Settings: thresholds, weights, issuer family and the fixed value lists.

Everything here is plain data. Functions in the package take a ``Settings``
(or use ``DEFAULT``) so that every rule threshold is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Fixed values. These must equal the values the original analyzer uses so
# that rules fire on the same inputs. Kept verbatim, in their natural order.
# --------------------------------------------------------------------------

# Suspicious host-name keywords (substring match on the normalised host).
SUSPICIOUS_KEYWORDS = ["login", "secure", "account", "sso", "billing"]

# Brand names whose appearance in a subject organisation is checked.
BRAND_KEYWORDS = [
    "amazon", "apple", "bankofamerica", "chase", "dropbox", "facebook", "github",
    "google", "microsoft", "okta", "onedrive", "outlook", "paypal", "stripe",
]

# Organisation tokens that never count as distinctive.
ORG_STOPWORDS = [
    "and", "co", "company", "corp", "corporation", "gmbh", "group", "holdings",
    "inc", "incorporated", "limited", "llc", "ltd", "of", "plc", "pte", "sa",
    "services", "solutions", "systems", "the",
]

# Character -> ASCII look-alike used by the confusable skeleton.
CONFUSABLE_CHAR_MAP = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "գ": "g",
    "α": "a", "β": "b", "γ": "y", "δ": "d", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ø": "o", "ö": "o", "ó": "o", "ò": "o", "ô": "o", "õ": "o",
    "ä": "a", "á": "a", "à": "a", "â": "a", "ã": "a", "å": "a",
    "ë": "e", "é": "e", "è": "e", "ê": "e",
    "ï": "i", "í": "i", "ì": "i", "î": "i",
    "ü": "u", "ú": "u", "ù": "u", "û": "u",
    "ñ": "n", "ç": "c",
}

# Signature hash names treated as deprecated.
DEPRECATED_SIG_ALGS = ["MD5", "SHA1"]

# Key-usage bits a leaf must not carry.
CA_KEY_USAGES = ["keyCertSign", "cRLSign"]

# DN formatting pattern: double spaces, leading comma, empty RDN.
SUSPICIOUS_DN_PATTERN = r"\s{2,}|(^,)|(,,)|,\s*,"

# CA/Browser Forum policy OIDs -> validation type (checked in this order).
VALIDATION_POLICY_OIDS = [("EV", "2.23.140.1.1"), ("OV", "2.23.140.1.2.2"), ("DV", "2.23.140.1.2.1")]

# Extended-key-usage OID -> label.
EKU_LABELS = {
    "1.3.6.1.5.5.7.3.1": "serverAuth",
    "1.3.6.1.5.5.7.3.2": "clientAuth",
    "1.3.6.1.5.5.7.3.3": "codeSigning",
    "1.3.6.1.5.5.7.3.4": "emailProtection",
    "1.3.6.1.5.5.7.3.8": "timeStamping",
    "1.3.6.1.5.5.7.3.9": "ocspSigning",
}

# Key-usage bit labels, bit 0 first.
KEY_USAGE_BITS = [
    "digitalSignature", "contentCommitment", "keyEncipherment", "dataEncipherment",
    "keyAgreement", "keyCertSign", "cRLSign", "encipherOnly", "decipherOnly",
]

# External linter: result status -> severity; statuses that are not findings.
EXTERNAL_LINT_SEVERITY = {"fatal": "high", "error": "high", "warn": "medium", "notice": "low", "info": "info"}
EXTERNAL_LINT_NON_FINDINGS = ["pass", "na", "ne", "not applicable", "not effective"]

# Issuer family kept by the ingest filter.
ISSUER_SUBSTRINGS = ["Go Daddy", "GoDaddy.com", "Starfield"]

# Windows a rollup refresh builds dashboard snapshots for, and the 12 stored breakdowns.
DASHBOARD_WINDOWS = [7, 30, 90, 365]
DASHBOARD_GROUP_BYS = [
    "issuer_cn", "validation_type", "sig_alg", "key_type", "key_size", "eku_set",
    "finding_code", "severity", "anomaly_bucket", "registered_domain",
    "validity_bucket", "san_count_bucket",
]
# All breakdown dimensions (the stored twelve plus issuer_dn).
BREAKDOWN_LABELS = {
    "issuer_cn": "issuer_common_name",
    "issuer_dn": "issuer_distinguished_name",
    "validation_type": "validation_type",
    "sig_alg": "signature_algorithm",
    "key_type": "key_type",
    "key_size": "key_size",
    "eku_set": "eku_set",
    "finding_code": "finding_code",
    "severity": "severity",
    "anomaly_bucket": "anomaly_bucket",
    "registered_domain": "registered_domain",
    "validity_bucket": "validity_bucket",
    "san_count_bucket": "san_count_bucket",
}


# ---- Fixed values: default thresholds, score weights and settings -------------
# They must equal the original's for equal results; stated plainly, one by one.

@dataclass(frozen=True)
class Thresholds:
    high_san_count: int = 25
    high_entropy_threshold: float = 3.6
    domain_burst_count: int = 5
    domain_burst_window_hours: int = 12
    medium_validity_days: int = 397
    high_validity_days: int = 825
    wildcard_baseline_rate: float = 0.15
    punycode_baseline_rate: float = 0.02
    suspicious_keywords: tuple[str, ...] = tuple(SUSPICIOUS_KEYWORDS)
    spike_multiplier: float = 2.5


@dataclass(frozen=True)
class Weights:
    high_san: int = 20
    wildcard: int = 8
    punycode: int = 15
    idn_confusable: int = 14
    org_domain_mismatch: int = 12
    brand_org_impersonation: int = 16
    domain_burst: int = 16
    entropy: int = 18
    keyword: int = 6
    validity: int = 12
    extension: int = 10
    eku: int = 8
    spike: int = 18


@dataclass(frozen=True)
class IssuerMatching:
    match_mode: str = "hybrid"  # issuer_dn | issuer_spki | hybrid
    issuer_substrings: tuple[str, ...] = tuple(ISSUER_SUBSTRINGS)
    issuer_spki_hashes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    window_days: int = 30
    retention_days: int = 30
    issuer_label: str = "godaddy"
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)
    matching: IssuerMatching = field(default_factory=IssuerMatching)


DEFAULT = Settings()
