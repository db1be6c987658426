import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from certlens.schemas import CERTIFICATES  # noqa: E402
from certlens.session import build_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app_name="certlens-tests")
    yield s
    s.stop()


def cert_row(**over):
    """A full ``certificates`` row with neutral defaults (a plain DV leaf)."""
    ts = datetime(2024, 1, 20, 12, 0, 0)
    row = {
        "cert_hash": "h1", "subject_cn": "login.example.com", "subject_dn": "CN=login.example.com",
        "subject_org": "", "issuer_cn": "Go Daddy Secure CA", "issuer_dn": "CN=Go Daddy Secure CA,O=Go Daddy",
        "issuer_spki_hash": None, "serial_number": "0x1", "not_before": ts, "not_after": ts,
        "dns_names": ["login.example.com"], "san_count": 1, "has_wildcard": 0, "has_punycode": 0,
        "validity_days": 90, "key_type": "RSA", "key_size": 2048, "sig_alg": "SHA256", "eku": ["serverAuth"],
        "key_usage": ["digitalSignature", "keyEncipherment"], "basic_constraints_ca": 0, "ski": None,
        "aki": None, "policy_oids": [], "aia_ocsp_urls": ["http://ocsp.example"], "crl_dp_urls": [],
        "validation_type": "Unknown", "has_must_staple": 0, "has_ip_san": 0, "has_uri_san": 0,
        "has_email_san": 0, "subject_has_non_ascii": 0, "issuer_has_non_ascii": 0, "subject_dn_length": 20,
        "issuer_dn_length": 31, "first_seen": ts, "last_seen": ts, "anomaly_score": 0,
    }
    row.update(over)
    return row


def certs_df(spark, *rows):
    df = spark.createDataFrame([cert_row(**r) for r in rows], CERTIFICATES)
    from pyspark.sql import functions as F
    return df.withColumn("issuer_key", F.lit("issuer-a"))
