"""The trigram index against scanning, and what its searches read."""

import random

import pytest
from pyspark.sql import functions as F

from certlens.catalog import AS_OF
from certlens.functions.timewin import Span
from certlens.plans import search as I
from certlens.plans import search_index as Ix
from certlens.plans.queries_lookup import search_index
from certlens.sources import adapters as A
from tests.conftest import SMOKE, certs_df


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAB.-é") for _ in range(rng.randrange(9)))
    rows = [{"cert_hash": f"h{i}", "subject_cn": rng.choice([word(), "", "common.example"]), "issuer_dn": f"CN={word()}", "eku": rng.sample(["serverAuth", "clientAuth", "x"], rng.randrange(4))} for i in range(150)]
    certs = certs_df(spark, *rows)
    found = [(f"h{rng.randrange(150)}", rng.choice(["SAN_MISSING", "DN_NON_ASCII", None, ""])) for _ in range(80)]
    findings = spark.createDataFrame(found, "cert_hash string, finding_code string")
    root = Ix.build_index(certs, findings, f"file://{tmp_path_factory.mktemp('index')}/ix")
    return rows, found, root


@pytest.mark.parametrize("needle", ["a", "ab", "AB.", "common", "b-é", "zzz", "abab", "n.e", "example", "ommon.ex"])
def test_matches_scanning(spark, small, needle):
    rows, found, root = small
    low = needle.lower()
    expected = {
        "subject_cn": {r["cert_hash"] for r in rows if low in (r["subject_cn"] or "").lower()},
        "issuer_dn": {r["cert_hash"] for r in rows if low in r["issuer_dn"].lower()},
        "eku": {r["cert_hash"] for r in rows if any(low in e.lower() for e in r["eku"])},
        "finding_code": {h for h, c in found if low in (c or "").lower()},
    }
    for field, hashes in expected.items():
        assert {r[0] for r in Ix.matching_certificates(spark, root, field, needle).collect()} == hashes, field


def test_long_results_are_joined(spark, small, monkeypatch):
    rows, _, root = small
    monkeypatch.setattr(Ix, "LISTED", 2)
    got = {r[0] for r in Ix.matching_certificates(spark, root, "issuer_dn", "cn=").collect()}
    assert got == {r["cert_hash"] for r in rows}


def test_the_rarest_grams_are_read(spark, small):
    _, _, root = small
    chosen = Ix.rarest_grams(spark, root, "subject_cn", "common.example")
    counts = {r.gram: r.n for r in spark.read.parquet(f"{root}/search_gram_counts").filter("field = 'subject_cn'").collect()}
    assert len(chosen) == Ix.GRAMS_READ and [counts[g] for g in chosen] == sorted(counts[g] for g in chosen)
    assert max(counts[g] for g in chosen) <= min(counts[f"common.example"[i:i + 3]] for i in range(12) if "common.example"[i:i + 3] not in chosen)
    assert Ix.rarest_grams(spark, root, "subject_cn", "never seen") is None


def test_grams_of_short_and_repeating_values(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), ("aaaaa",), ("é😀x",), (None,)], "v string")
    got = [r[0] for r in df.select(Ix.grams(F.col("v"))).collect()]
    assert got == [[], [], ["abc"], ["aaa"], ["é😀x"], []]


def test_scans_are_filtered(spark):
    root = search_index(spark, SMOKE)
    plan = Ix.matching_values(spark, root, "subject_cn", "customer#00000004")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "In(gram, [" in plan.split("PushedFilters")[1] and "search_grams" in plan
    assert "/certificates" not in plan
    t = A.tables(spark, SMOKE)
    found = Ix.search_indexed(root, t.observations, t.certificates, t.findings, Span.trailing(AS_OF, 30), 20, I.SearchFilters(subject_cn_contains="customer#00000004"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and plan.count("In(cert_hash") >= 2


def test_empty_tables(spark, tmp_path):
    certs = certs_df(spark, {}).limit(0)
    findings = spark.createDataFrame([], "cert_hash string, finding_code string")
    one = certs_df(spark, {"cert_hash": "h", "subject_cn": "", "eku": []})
    root = Ix.build_index(one.unionByName(certs), findings, f"file://{tmp_path}/ix")
    assert Ix.matching_certificates(spark, root, "subject_cn", "abc").collect() == []
    assert [r[0] for r in Ix.matching_certificates(spark, root, "issuer_dn", "go daddy").collect()] == ["h"]
