"""Issuer-family filter (A9), issuer key (A10) and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certlens.config import IssuerMatching


def issuer_matches(matching: IssuerMatching = IssuerMatching(), issuer_dn: str = "issuer_dn",
                   issuer_spki_hash: str = "issuer_spki_hash") -> Column:
    """Case-insensitive DN substring (any of) / SPKI hash membership / both."""
    dn = F.lower(F.col(issuer_dn))
    subs = [s.lower() for s in matching.issuer_substrings]
    dn_match = F.lit(False)
    for s in subs:
        dn_match = dn_match | dn.contains(s)
    spki = F.col(issuer_spki_hash)
    hashes = list(matching.issuer_spki_hashes)
    spki_match = F.coalesce(spki.isin(*hashes), F.lit(False)) if hashes else F.lit(False)
    if matching.match_mode == "issuer_dn":
        return dn_match
    if matching.match_mode == "issuer_spki":
        return spki_match
    return dn_match | spki_match


def issuer_key(issuer_dn: str = "issuer_dn", issuer_spki_hash: str = "issuer_spki_hash") -> Column:
    """The issuer SPKI hash when present, else the SHA-256 of the issuer DN."""
    spki = F.col(issuer_spki_hash)
    return F.when(spki.isNotNull() & (spki != ""), spki).otherwise(F.sha2(F.col(issuer_dn), 256))


def fingerprint(der: Column) -> Column:
    """SHA-256 hex of the DER bytes (certificate hash / SPKI hash)."""
    return F.sha2(der.cast("binary"), 256)
