import json

from pyspark.sql import functions as F

from certlens.functions import hostnames as Hn
from certlens.functions.unicode import host_idna_table, organization_tokens
from certlens.sources import psl


def _one(spark, col_fn, value):
    return spark.createDataFrame([(value,)], "x string").select(col_fn(F.col("x")).alias("y")).first()["y"]


def test_registered_domain(spark):
    hosts = spark.createDataFrame([("foo.bar.example.co.uk",), ("*.login.example.com",), ("",), ("co.uk",),
                                   ("x.y.ck",), ("www.ck",), ("www.site7.example",)], "host string")
    got = {r["host"]: r["registered_domain"] for r in
           psl.registered_domain_table(hosts, psl.rules_frame(spark, psl.FIXTURE_RULES), "host", len(psl.FIXTURE_RULES)).collect()}
    assert got["foo.bar.example.co.uk"] == "example.co.uk"
    assert got["*.login.example.com"] == "example.com"
    assert got[""] == ""
    assert got["co.uk"] == "co.uk"
    assert got["x.y.ck"] == "x.y.ck"          # wildcard rule *.ck
    assert got["www.ck"] == "www.ck"          # exception rule !www.ck
    assert got["www.site7.example"] == "site7.example"  # default rule


def test_tokenize_domain(spark):
    assert _one(spark, Hn.tokenize_domain, "a.b.example.com") == [
        "a.b.example.com", "b.example.com", "example.com", "com"]
    assert _one(spark, Hn.tokenize_domain, "*.") == []


def test_idna_and_confusable(spark):
    hosts = spark.createDataFrame([("xn--bcher-kva.example",), ("*.xn--bcher-kva.example",),
                                   ("www.xn--ellraboutique-dnb.com",), ("plain.example.com",)], "host string")
    got = {r["host"]: r for r in host_idna_table(hosts).collect()}
    assert got["xn--bcher-kva.example"]["unicode_hostname"] == "bücher.example"
    assert got["*.xn--bcher-kva.example"]["unicode_hostname"] == "*.bücher.example"
    conf = got["www.xn--ellraboutique-dnb.com"]
    assert conf["unicode_hostname"] == "www.elløraboutique.com"
    assert json.loads(conf["confusable_json"]) == {
        "hostname": "www.xn--ellraboutique-dnb.com", "unicode_hostname": "www.elløraboutique.com",
        "matches": [{"label": "elløraboutique", "mixed_script": False, "scripts": ["latin"], "skeleton": "elloraboutique"}]}
    assert got["plain.example.com"]["confusable_json"] is None


def test_entropy_orders(spark):
    e = lambda h: _one(spark, Hn.highest_label_entropy, h)
    assert e("aaaaaa.example.com") < e("a9x3kq7z.example.com")
    assert e("ülkermuhendislik.com") < e("xn--lkermuhendislik-yvb.com")


def test_keywords_and_punycode(spark):
    assert _one(spark, Hn.suspicious_keywords, "Secure-Login.Example.com.") == ["login", "secure"]
    assert _one(spark, Hn.has_punycode, "XN--bcher-kva.example") is True


def test_org_tokens(spark):
    assert _one(spark, organization_tokens, "Microsoft Corporation") == ["microsoft"]
    assert _one(spark, organization_tokens, "Société Générale SA") == ["societe", "generale"]
