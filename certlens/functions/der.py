"""Minimal DER reader for X.509 certificates: the per-certificate helper
behind the feature-extraction job (A8). It walks the ASN.1 structure and
returns the ``certificates`` columns; it is called from ``mapInPandas``
on distinct, not yet known certificates only.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone
from functools import lru_cache

# --------------------------------------------------------------------------
# OIDs and names used by X.509 (RFC 5280, RFC 4514, RFC 5480,
# RFC 8410, CA/Browser Forum). Kept together, in natural order.
# --------------------------------------------------------------------------
NAME_ATTRS = {
    "2.5.4.3": "CN", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.6": "C",
    "2.5.4.9": "STREET", "0.9.2342.19200300.100.1.25": "DC", "0.9.2342.19200300.100.1.1": "UID",
}
SIG_HASH = {
    "1.2.840.113549.1.1.4": "MD5", "1.2.840.113549.1.1.5": "SHA1", "1.2.840.113549.1.1.14": "SHA224",
    "1.2.840.113549.1.1.11": "SHA256", "1.2.840.113549.1.1.12": "SHA384", "1.2.840.113549.1.1.13": "SHA512",
    "1.2.840.10045.4.1": "SHA1", "1.2.840.10045.4.3.1": "SHA224", "1.2.840.10045.4.3.2": "SHA256",
    "1.2.840.10045.4.3.3": "SHA384", "1.2.840.10045.4.3.4": "SHA512",
    "1.2.840.10040.4.3": "SHA1", "2.16.840.1.101.3.4.3.2": "SHA256",
}
SIG_NAMES = {"1.3.101.112": "ed25519", "1.3.101.113": "ed448"}
RSA_PSS = "1.2.840.113549.1.1.10"
HASH_OIDS = {"1.3.14.3.2.26": "SHA1", "2.16.840.1.101.3.4.2.4": "SHA224", "2.16.840.1.101.3.4.2.1": "SHA256",
             "2.16.840.1.101.3.4.2.2": "SHA384", "2.16.840.1.101.3.4.2.3": "SHA512"}
RSA_KEY, EC_KEY, DSA_KEY, ED25519_KEY, ED448_KEY = (
    "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "1.2.840.10040.4.1", "1.3.101.112", "1.3.101.113")
EC_CURVE_BITS = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.10": 256,
                 "1.2.840.10045.3.1.1": 192, "1.3.132.0.33": 224}
EXT_SAN, EXT_EKU, EXT_KU, EXT_BC = "2.5.29.17", "2.5.29.37", "2.5.29.15", "2.5.29.19"
EXT_SKI, EXT_AKI, EXT_POLICIES, EXT_CRL = "2.5.29.14", "2.5.29.35", "2.5.29.32", "2.5.29.31"
EXT_AIA, EXT_TLS_FEATURE, AIA_OCSP = "1.3.6.1.5.5.7.1.1", "1.3.6.1.5.5.7.1.24", "1.3.6.1.5.5.7.48.1"
TLS_STATUS_REQUEST = 5
#: Values that many certificates have in common (OIDs, times, extension contents) are
#: decoded once; the least recently used ones go.
REMEMBERED = 4096


class DerError(ValueError):
    pass


def _read(buf: bytes, pos: int) -> tuple[int, int, int]:
    """(tag, value_start, value_end) of the TLV at ``pos``."""
    if pos + 2 > len(buf):
        raise DerError("truncated")
    tag, first = buf[pos], buf[pos + 1]
    pos += 2
    if first & 0x80:
        n = first & 0x7F
        if n == 0 or n > 4 or pos + n > len(buf):
            raise DerError("bad length")
        length = int.from_bytes(buf[pos:pos + n], "big")
        pos += n
    else:
        length = first
    if pos + length > len(buf):
        raise DerError("truncated value")
    return tag, pos, pos + length


def _items(buf: bytes, start: int, end: int):
    pos = start
    while pos < end:
        tag, s, e = _read(buf, pos)
        yield tag, s, e, pos
        pos = e


def _kids(buf, start, end):
    out = []
    while start < end:
        item = _read(buf, start)
        out.append(item)
        start = item[2]
    return out


@lru_cache(REMEMBERED)
def _oid(b: bytes) -> str:
    arcs, value = [], 0
    for byte in b:
        value = (value << 7) | (byte & 0x7F)
        if not byte & 0x80:
            arcs.append(value)
            value = 0
    if not arcs:
        raise DerError("empty oid")
    first = min(arcs[0] // 40, 2)
    return ".".join(str(x) for x in [first, arcs[0] - 40 * first] + arcs[1:])


def _text(tag: int, b: bytes) -> str:
    if tag == 0x1E:
        return b.decode("utf-16-be")
    if tag == 0x1C:
        return b.decode("utf-32-be")
    if tag == 0x14:
        return b.decode("latin-1")
    return b.decode("utf-8")


@lru_cache(REMEMBERED)
def _time(tag: int, b: bytes) -> datetime:
    s = b.decode("ascii").rstrip("Z")
    if tag == 0x17:
        year = int(s[:2])
        s = ("19" if year >= 50 else "20") + s
    fmt = "%Y%m%d%H%M%S" if len(s) >= 14 else "%Y%m%d%H%M"
    return datetime.strptime(s[:14] if len(s) >= 14 else s, fmt).replace(tzinfo=timezone.utc)


@lru_cache(REMEMBERED)
def _escape(value: str) -> str:
    """RFC 4514 section 2.4 escaping of an attribute value."""
    if not value:
        return ""
    out = value.replace("\\", "\\\\")
    for ch in '"+,;<>':
        out = out.replace(ch, "\\" + ch)
    out = out.replace("\0", "\\00")
    if out[0] in "# ":
        out = "\\" + out
    if out[-1] == " ":
        out = out[:-1] + "\\ "
    return out


def _name(buf, s, e) -> tuple[str, list[tuple[str, str]]]:
    """(RFC 4514 string, [(oid, value), ...] in encoded order)."""
    rdns, flat = [], []
    for _, rs, re_ in _kids(buf, s, e):
        parts = []
        for _, as_, ae in _kids(buf, rs, re_):
            (ot, os_, oe), (vt, vs, ve) = _kids(buf, as_, ae)[:2]
            oid = _oid(buf[os_:oe])
            val = _text(vt, buf[vs:ve])
            flat.append((oid, val))
            parts.append(f"{NAME_ATTRS.get(oid, oid)}={_escape(val)}")
        rdns.append("+".join(parts))
    return ",".join(reversed(rdns)), flat


def _first(flat, oid) -> str:
    return next((v for o, v in flat if o == oid), "")


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big", signed=True)


def _general_names(buf, s, e) -> dict[int, list]:
    out: dict[int, list] = {}
    for t, gs, ge in _kids(buf, s, e):
        out.setdefault(t & 0x1F, []).append(buf[gs:ge])
    return out


def _key_info(buf, s, e) -> tuple[str, int, bytes]:
    (at, as_, ae), (bt, bs, be) = _kids(buf, s, e)[:2]
    alg = _kids(buf, as_, ae)
    oid = _oid(buf[alg[0][1]:alg[0][2]])
    bits = buf[bs + 1:be]  # BIT STRING without the unused-bits byte
    if oid == RSA_KEY:
        (mt, ms, me) = _kids(bits, 0, len(bits))[0]
        mod = _kids(bits, ms, me)[0]
        return "RSA", _int(bits[mod[1]:mod[2]]).bit_length(), buf[s - 0:e]
    if oid == EC_KEY:
        curve = _oid(buf[alg[1][1]:alg[1][2]]) if len(alg) > 1 and alg[1][0] == 0x06 else ""
        return "ECDSA", EC_CURVE_BITS.get(curve, 0), buf[s:e]
    if oid == ED25519_KEY:
        return "Ed25519", 256, buf[s:e]
    if oid == ED448_KEY:
        return "Ed448", 456, buf[s:e]
    if oid == DSA_KEY and len(alg) > 1:
        p = _kids(buf, alg[1][1], alg[1][2])[0]
        return "DSA", _int(buf[p[1]:p[2]]).bit_length(), buf[s:e]
    return "Unknown", 0, buf[s:e]


def _sig_alg(buf, s, e) -> str:
    alg = _kids(buf, s, e)
    oid = _oid(buf[alg[0][1]:alg[0][2]])
    if oid in SIG_HASH:
        return SIG_HASH[oid]
    if oid == RSA_PSS:
        h = "SHA1"
        if len(alg) > 1:
            for t, ps, pe in _kids(buf, alg[1][1], alg[1][2]):
                if t == 0xA0:
                    inner = _kids(buf, ps, pe)[0]
                    hid = _kids(buf, inner[1], inner[2])[0]
                    h = HASH_OIDS.get(_oid(buf[hid[1]:hid[2]]), h)
        return h
    return SIG_NAMES.get(oid, oid)


@lru_cache(REMEMBERED)
def _extended_usages(v: bytes) -> tuple[str, ...]:
    from certlens.config import EKU_LABELS
    oids = [_oid(v[s:e]) for _, s, e in _kids(v, *_read(v, 0)[1:])]
    return tuple(EKU_LABELS.get(oid, oid) for oid in oids)


@lru_cache(REMEMBERED)
def _key_usages(v: bytes) -> tuple[str, ...]:
    from certlens.config import KEY_USAGE_BITS
    _, s, e = _read(v, 0)
    bits = int.from_bytes(v[s + 1:e], "big") if e > s + 1 else 0
    width = 8 * (e - s - 1)
    flags = [bool(bits >> (width - 1 - k) & 1) if k < width else False for k in range(9)]
    # encipherOnly / decipherOnly are only defined with keyAgreement.
    return tuple(label for k, label in enumerate(KEY_USAGE_BITS) if flags[k] and (k < 7 or flags[4]))


@lru_cache(REMEMBERED)
def _policies(v: bytes) -> tuple[str, ...]:
    out = []
    for _, s, e in _kids(v, *_read(v, 0)[1:]):
        pid = _kids(v, s, e)[0]
        out.append(_oid(v[pid[1]:pid[2]]))
    return tuple(out)


@lru_cache(REMEMBERED)
def _ocsp_urls(v: bytes) -> tuple[str, ...]:
    out = []
    for _, s, e in _kids(v, *_read(v, 0)[1:]):
        (mt, ms, me), (lt, ls, le) = _kids(v, s, e)[:2]
        if _oid(v[ms:me]) == AIA_OCSP and lt & 0x1F == 6:
            out.append(v[ls:le].decode("ascii", "replace"))
    return tuple(out)


def parse_certificate(der: bytes) -> dict:
    """Features of one DER certificate (the A8b columns)."""
    cert = _read(der, 0)
    tbs, sig = _kids(der, cert[1], cert[2])[:2]
    fields = _kids(der, tbs[1], tbs[2])
    i = 1 if fields[0][0] == 0xA0 else 0
    serial = _int(der[fields[i][1]:fields[i][2]])
    if serial <= 0:
        raise DerError("serial number below one")
    issuer_dn, issuer_flat = _name(der, fields[i + 2][1], fields[i + 2][2])
    validity = _kids(der, fields[i + 3][1], fields[i + 3][2])
    not_before = _time(validity[0][0], der[validity[0][1]:validity[0][2]])
    not_after = _time(validity[1][0], der[validity[1][1]:validity[1][2]])
    subject_dn, subject_flat = _name(der, fields[i + 4][1], fields[i + 4][2])
    key_type, key_size, _ = _key_info(der, fields[i + 5][1], fields[i + 5][2])
    exts: dict[str, tuple[bool, bytes]] = {}
    for t, s, e in fields[i + 6:]:
        if t == 0xA3:
            seq = _kids(der, s, e)[0]
            for _, es, ee in _kids(der, seq[1], seq[2]):
                parts = _kids(der, es, ee)
                oid = _oid(der[parts[0][1]:parts[0][2]])
                crit = len(parts) == 3 and der[parts[1][1]:parts[1][2]] != b"\x00"
                exts[oid] = (crit, der[parts[-1][1]:parts[-1][2]])
    dns, ip, uri, email = [], 0, 0, 0
    if EXT_SAN in exts:
        v = exts[EXT_SAN][1]
        names = _general_names(v, *_read(v, 0)[1:])
        dns = [x.decode("ascii", "replace") for x in names.get(2, [])]
        ip, uri, email = len(names.get(7, [])), len(names.get(6, [])), len(names.get(1, []))
    eku = list(_extended_usages(exts[EXT_EKU][1])) if EXT_EKU in exts else []
    key_usage = list(_key_usages(exts[EXT_KU][1])) if EXT_KU in exts else []
    ca = 0
    if EXT_BC in exts:
        v = exts[EXT_BC][1]
        kids = _kids(v, *_read(v, 0)[1:])
        ca = int(bool(kids and kids[0][0] == 0x01 and v[kids[0][1]:kids[0][2]] != b"\x00"))
    ski = aki = None
    if EXT_SKI in exts:
        v = exts[EXT_SKI][1]
        _, s, e = _read(v, 0)
        ski = v[s:e].hex()
    if EXT_AKI in exts:
        v = exts[EXT_AKI][1]
        for t, s, e in _kids(v, *_read(v, 0)[1:]):
            if t == 0x80:
                aki = v[s:e].hex()
    policies = list(_policies(exts[EXT_POLICIES][1])) if EXT_POLICIES in exts else []
    ocsp = list(_ocsp_urls(exts[EXT_AIA][1])) if EXT_AIA in exts else []
    crl = []
    if EXT_CRL in exts:
        v = exts[EXT_CRL][1]
        for _, s, e in _kids(v, *_read(v, 0)[1:]):
            for t, ds, de in _kids(v, s, e):
                if t == 0xA0:
                    for ft, fs, fe in _kids(v, ds, de):
                        if ft == 0xA0:
                            crl += [x.decode("utf-8", "replace") for xs in _general_names(v, fs, fe).values()
                                    for x in xs]
    must_staple = 0
    if EXT_TLS_FEATURE in exts:
        v = exts[EXT_TLS_FEATURE][1]
        must_staple = int(any(_int(v[s:e]) == TLS_STATUS_REQUEST for _, s, e in _kids(v, *_read(v, 0)[1:])))
    return {
        "subject_cn": _first(subject_flat, "2.5.4.3"), "subject_dn": subject_dn,
        "subject_org": _first(subject_flat, "2.5.4.10"), "issuer_cn": _first(issuer_flat, "2.5.4.3"),
        "issuer_dn": issuer_dn, "serial_number": hex(serial), "not_before": not_before, "not_after": not_after,
        "dns_names": dns, "san_count": len(dns),
        "has_wildcard": int(any(n.startswith("*.") for n in dns)),
        "has_punycode": int(any("xn--" in n.strip().lower().rstrip(".") for n in dns)),
        "validity_days": max((not_after - not_before).days, 0), "key_type": key_type, "key_size": key_size,
        "sig_alg": _sig_alg(der, sig[1], sig[2]), "eku": eku, "key_usage": key_usage, "basic_constraints_ca": ca,
        "ski": ski, "aki": aki, "policy_oids": policies, "aia_ocsp_urls": ocsp, "crl_dp_urls": crl,
        "has_must_staple": must_staple, "has_ip_san": int(ip > 0), "has_uri_san": int(uri > 0),
        "has_email_san": int(email > 0),
    }


def spki_sha256(der: bytes) -> str:
    """SHA-256 hex of a certificate's SubjectPublicKeyInfo (issuer key hash, A7)."""
    cert = _read(der, 0)
    tbs = _kids(der, cert[1], cert[2])[0]
    fields = _items(der, tbs[1], tbs[2])
    items = list(fields)
    i = 1 if items[0][0] == 0xA0 else 0
    _, s, e, start = items[i + 5]
    return hashlib.sha256(der[start:e]).hexdigest()
