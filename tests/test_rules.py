import json

from certlens.operators import lint as Ln
from certlens.operators import signals as Sg
from certlens.operators.certfeatures import attach_name_features
from certlens.sources import psl
from tests.conftest import certs_df


def _prepare(spark, certs, bursts=None, baselines=None):
    feats = attach_name_features(certs, psl.rules_frame(spark, psl.FIXTURE_RULES), len(psl.FIXTURE_RULES), bursts)
    return Sg.attach_baseline(Ln.with_org_tokens(feats), baselines)


def _codes(findings):
    return sorted(r["finding_code"] for r in findings.collect())


def test_weak_rsa_lint(spark):
    certs = certs_df(spark, dict(dns_names=[], san_count=0, key_size=1024,
                                 key_usage=["digitalSignature", "keyCertSign"]))
    codes = _codes(Ln.lint_findings(_prepare(spark, certs), "2024-01-31 00:00:00"))
    for code in ("SAN_MISSING", "RSA_KEY_TOO_SMALL", "LEAF_KEY_USAGE_CA_BITS"):
        assert code in codes


def test_org_checks(spark):
    certs = certs_df(spark, dict(subject_org="Microsoft Corporation", dns_names=["secure-login-example.net"],
                                 subject_cn="secure-login-example.net", validation_type="OV",
                                 policy_oids=["2.23.140.1.2.2"]))
    prepared = _prepare(spark, certs)
    lint = {r["finding_code"]: r for r in Ln.lint_findings(prepared, "2024-01-31 00:00:00").collect()}
    assert lint["ORG_DOMAIN_MISMATCH"]["severity"] == "medium"
    assert lint["ORG_BRAND_IMPERSONATION"]["severity"] == "medium"
    ev = json.loads(lint["ORG_BRAND_IMPERSONATION"]["evidence_json"])
    assert ev["brand_matches"] == ["microsoft"] and ev["domain_tokens"] == ["example", "login", "net", "secure"]
    sig = {r["code"]: r for r in Sg.signal_rows(Sg.score_certificates(prepared)).collect()}
    assert sig["org_domain_mismatch"]["severity"] == "medium"
    assert sig["brand_org_impersonation"]["severity"] == "high"


def test_burst_signal(spark):
    certs = certs_df(spark, dict(dns_names=["login.example.com"]))
    bursts = spark.createDataFrame([("example.com", 5)], "registered_domain string, cert_count long")
    sig = {r["code"]: r for r in Sg.signal_rows(Sg.score_certificates(_prepare(spark, certs, bursts))).collect()}
    burst = sig["registered_domain_burst"]
    assert burst["severity"] == "medium"
    assert json.loads(burst["evidence_json"])["matches"][0]["registered_domain"] == "example.com"


def test_score_and_top_signals(spark):
    certs = certs_df(spark, dict(cert_hash="a", san_count=30, has_wildcard=1, validity_days=900, has_ip_san=1,
                                 dns_names=["*.login.example.com"] + [f"n{i}.example.com" for i in range(29)]),
                     dict(cert_hash="b"))
    scored = {r["cert_hash"]: r for r in Sg.score_certificates(_prepare(spark, certs)).collect()}
    a = scored["a"]
    assert 0 <= a["anomaly_score"] <= 100
    assert [s["code"] for s in a["top_signals"]] == ["high_san_count", "validity_long", "rare_san_types"]
    assert a["anomaly_score"] == min(sum(s["score"] for s in a["signals"]), 100)
    # The unchanged certificate still gets a finding (score of the keyword signal only).
    finding = Sg.anomaly_finding(Sg.score_certificates(_prepare(spark, certs)), "2024-01-31 00:00:00")
    rows = {r["cert_hash"]: json.loads(r["evidence_json"]) for r in finding.collect()}
    assert rows["b"]["anomaly_score"] == 6 and rows["b"]["top_signals"][0]["code"] == "suspicious_keywords"
    assert rows["a"]["top_signals"][0]["evidence"]["threshold"] == 25


def test_idn_rule(spark):
    certs = certs_df(spark, dict(dns_names=["www.xn--ellraboutique-dnb.com"], has_punycode=1))
    codes = _codes(Ln.lint_findings(_prepare(spark, certs), None))
    assert "IDN_CONFUSABLE" in codes
    sig = [r["code"] for r in Sg.signal_rows(Sg.score_certificates(_prepare(spark, certs))).collect()]
    assert "idn_confusable" in sig and "punycode_san" in sig


def test_fast_mode_baseline_free(spark):
    certs = certs_df(spark, dict(has_wildcard=1, has_punycode=1))
    sig = {r["code"]: r["severity"] for r in Sg.signal_rows(Sg.score_certificates(_prepare(spark, certs))).collect()}
    assert sig["wildcard_san"] == "info" and sig["punycode_san"] == "info"
    base = spark.createDataFrame([("issuer-a", 100.0, 0.01, 0.0, ["serverAuth"], 10, 2.0)],
                                 "issuer_key string, validity_p95 double, wildcard_rate double, punycode_rate double,"
                                 " common_eku_sets array<string>, current_day_count long, trailing_daily_avg double")
    sig2 = {r["code"]: r["severity"] for r in
            Sg.signal_rows(Sg.score_certificates(_prepare(spark, certs, baselines=base))).collect()}
    assert sig2["wildcard_san"] == "medium" and sig2["punycode_san"] == "low" and "issuer_spike" in sig2
    assert "validity_outlier" not in sig2  # 90 days < p95 100


def test_every_rule_and_signal_has_a_case():
    """The checked queries reach all of them (their rows are compared with the twins)."""
    from certlens.plans.queries_rules import LINT_CASES, SIGNAL_CASES, _LINT_RULES

    assert {code for rows in LINT_CASES.values() for code, _ in rows} == {r[0] for r in _LINT_RULES} and len(_LINT_RULES) == 15
    assert len({code for rows in SIGNAL_CASES.values() for code, *_ in rows}) == 15
