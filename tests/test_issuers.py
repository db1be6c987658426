import hashlib

from pyspark.sql import functions as F

from certlens.config import IssuerMatching
from certlens.functions.certcols import validation_type
from certlens.operators.issuers import fingerprint, issuer_key, issuer_matches


def test_family_by_name_by_key_or_by_either(spark):
    rows = [("by name, upper case", "CN=NORTHWIND Root R1,O=Northwind Trust", "k-9"), ("by key alone", "CN=Unrelated", "k-1"),
            ("neither", "CN=Unrelated", "k-2"), ("no key", "CN=northwind", None), ("no name", None, "k-1"), ("nothing", None, None)]
    df = spark.createDataFrame(rows, "what string, issuer_dn string, issuer_spki_hash string")
    family = {"issuer_substrings": ("northwind", "Contoso CA"), "issuer_spki_hashes": ("k-1", "k-7")}
    found = {mode: {r.what for r in df.filter(issuer_matches(IssuerMatching(match_mode=mode, **family))).collect()} for mode in ("issuer_dn", "issuer_spki", "hybrid")}
    assert found["issuer_dn"] == {"by name, upper case", "no key"}
    assert found["issuer_spki"] == {"by key alone", "no name"}
    assert found["hybrid"] == found["issuer_dn"] | found["issuer_spki"]


def test_issuer_key(spark):
    df = spark.createDataFrame([("CN=A", None), ("CN=A", "ff")], "issuer_dn string, issuer_spki_hash string")
    keys = [r[0] for r in df.select(issuer_key()).collect()]
    assert keys == [hashlib.sha256(b"CN=A").hexdigest(), "ff"]


def test_validation_type(spark):
    df = spark.createDataFrame([(["2.23.140.1.2.1"],), (["2.23.140.1.2.2"],), (["2.23.140.1.1"],), ([],)],
                               "policy_oids array<string>")
    assert [r[0] for r in df.select(validation_type()).collect()] == ["DV", "OV", "EV", "Unknown"]


def test_fingerprint_stable(spark):
    der = bytes(range(64))
    df = spark.createDataFrame([(bytearray(der),)], "der binary")
    assert df.select(fingerprint(F.col("der"))).first()[0] == hashlib.sha256(der).hexdigest()
