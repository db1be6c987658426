"""DER certificates derived from driver rows (adapter input for A8).

The driver data holds no certificates, so this adapter encodes one X.509
certificate per ``customer`` row (subject from ``c_name``, SANs, validity
from ``c_acctbal``, key and signature types from ``c_custkey``) with a
small DER writer. The feature-extraction job then parses them back, and
the DuckDB twin derives the expected features from the same rows.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _len(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    b = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([0x80 | len(b)]) + b


def tlv(tag: int, content: bytes) -> bytes:
    return bytes([tag]) + _len(len(content)) + content


def seq(*parts: bytes) -> bytes:
    return tlv(0x30, b"".join(parts))


def integer(v: int) -> bytes:
    return tlv(0x02, v.to_bytes(max(1, (v.bit_length() + 8) // 8), "big", signed=True))


@lru_cache(256)
def oid(dotted: str) -> bytes:
    arcs = [int(x) for x in dotted.split(".")]
    out = bytearray([40 * arcs[0] + arcs[1]])
    for a in arcs[2:]:
        chunk = [a & 0x7F]
        a >>= 7
        while a:
            chunk.append(0x80 | (a & 0x7F))
            a >>= 7
        out += bytes(reversed(chunk))
    return tlv(0x06, bytes(out))


def utf8(s: str) -> bytes:
    return tlv(0x0C, s.encode("utf-8"))


@lru_cache(4096)
def utctime(t: datetime) -> bytes:
    return tlv(0x17, t.strftime("%y%m%d%H%M%SZ").encode())


def name(*attrs: tuple[str, str]) -> bytes:
    return seq(*[tlv(0x31, seq(oid(o), utf8(v))) for o, v in attrs])


def ext(oid_s: str, value: bytes, critical: bool = False) -> bytes:
    return seq(oid(oid_s), *([tlv(0x01, b"\xff")] if critical else []), tlv(0x04, value))


SHA256_RSA, SHA1_RSA, ECDSA_SHA384 = "1.2.840.113549.1.1.11", "1.2.840.113549.1.1.5", "1.2.840.10045.4.3.3"
EKU_OIDS = {"serverAuth": "1.3.6.1.5.5.7.3.1", "clientAuth": "1.3.6.1.5.5.7.3.2",
            "emailProtection": "1.3.6.1.5.5.7.3.4"}
EPOCH = datetime(2024, 1, 1)


def customer_certificate(key: int, c_name: str, segment: str, nation: int, acctbal: float) -> bytes:
    site = key % 20
    nb = EPOCH + timedelta(days=key % 28)
    na = nb + timedelta(days=int(abs(acctbal) // 12))
    sig = SHA1_RSA if key % 5 == 0 else (ECDSA_SHA384 if key % 5 == 1 else SHA256_RSA)
    if key % 4 in (0, 1):
        bits = 1024 if key % 4 == 0 else 2048
        modulus = (1 << (bits - 1)) | (2 * key + 1)
        spki = seq(seq(oid("1.2.840.113549.1.1.1"), tlv(0x05, b"")),
                   tlv(0x03, b"\x00" + seq(integer(modulus), integer(65537))))
    elif key % 4 == 2:
        spki = seq(seq(oid("1.2.840.10045.2.1"), oid("1.2.840.10045.3.1.7")), tlv(0x03, b"\x00\x04" + bytes(64)))
    else:
        spki = seq(seq(oid("1.3.101.112")), tlv(0x03, b"\x00" + bytes(32)))
    sans = [tlv(0x82, f"www.site{site}.example".encode()), tlv(0x82, f"login.site{site}.example".encode())]
    if key % 13 == 0:
        sans.append(tlv(0x87, bytes([10, 0, site, 1])))
    eku = {0: ["serverAuth"], 1: ["serverAuth", "clientAuth"], 2: ["emailProtection"],
           3: ["clientAuth", "serverAuth"]}[key % 4]
    policies = {0: ["2.23.140.1.1"], 1: ["2.23.140.1.2.2"], 2: ["2.23.140.1.2.1"],
                3: ["2.23.140.1.2.1", "2.23.140.1.2.2"], 4: ["1.3.6.1.4.1"]}[key % 5]
    ca = key % 29 == 0
    ku_bits = 0b10100000 | (0b00000100 if ca else 0)  # digitalSignature, keyEncipherment (+ keyCertSign)
    exts = [
        ext("2.5.29.17", seq(*sans)),
        ext("2.5.29.37", seq(*[oid(EKU_OIDS[e]) for e in eku])),
        ext("2.5.29.15", tlv(0x03, bytes([0x02 if ca else 0x05, ku_bits])), critical=True),
        ext("2.5.29.19", seq(*([tlv(0x01, b"\xff")] if ca else [])), critical=True),
        ext("2.5.29.14", tlv(0x04, hashlib.sha1(str(key).encode()).digest())),
        ext("2.5.29.32", seq(*[seq(oid(p)) for p in policies])),
    ]
    if key % 6 != 0:
        exts.append(ext("1.3.6.1.5.5.7.1.1", seq(seq(oid("1.3.6.1.5.5.7.48.1"),
                                                     tlv(0x86, f"http://ocsp{site}.example".encode())))))
    if key % 23 == 0:
        exts.append(ext("1.3.6.1.5.5.7.1.24", seq(integer(5))))
    subject = [("2.5.4.3", c_name)] + ([("2.5.4.10", f"Org {nation}")] if key % 2 == 0 else [])
    tbs = seq(tlv(0xA0, integer(2)), integer(key + 1), seq(oid(sig)),
              name(("2.5.4.6", "US"), ("2.5.4.10", f"{segment} Trust"), ("2.5.4.3", f"{segment} CA")),
              seq(utctime(nb), utctime(na)), name(*subject), spki, tlv(0xA3, seq(*exts)))
    return seq(tbs, seq(oid(sig)), tlv(0x03, b"\x00" + hashlib.sha256(tbs).digest()))


def _encode(batches):
    for pdf in batches:
        ders = [customer_certificate(int(k), n, s, int(nk), float(b)) for k, n, s, nk, b in
                zip(pdf["c_custkey"], pdf["c_name"], pdf["c_mktsegment"], pdf["c_nationkey"], pdf["c_acctbal"])]
        yield pd.DataFrame({"c_custkey": pdf["c_custkey"], "der": ders})


def customer_certificates(customer: DataFrame) -> DataFrame:
    """(c_custkey, der) - one DER certificate per customer row. The rows are dealt out
    first: the table is small and may lie in one file, the encoding is slow."""
    cols = customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal").repartition("c_custkey")
    return cols.mapInPandas(_encode, "c_custkey long, der binary").select(
        "c_custkey", F.col("der"))
