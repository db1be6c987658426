import json

from pyspark.sql import functions as F

from certlens.operators.external_lint import external_lint_findings, finding_code


def test_code_normalisation(spark):
    df = spark.createDataFrame([("e_subject_common_name_not_from_san",), ("w-ext.key usage",)], "n string")
    got = [r[0] for r in df.select(finding_code(F.col("n"))).collect()]
    assert got == ["ZLINT_E_SUBJECT_COMMON_NAME_NOT_FROM_SAN", "ZLINT_W_EXT_KEY_USAGE"]


def test_field_extraction(spark):
    payload = json.dumps({"results": {
        "e_subject_common_name_not_from_san": {"result": "warn", "details": "example", "source": "RFC 5280"},
        "n_passing": {"result": "pass"}, "w_bare": "notice", "i_status_form": {"status": "info", "detail": "d"}}})
    df = spark.createDataFrame([("h", payload)], "cert_hash string, result_json string")
    rows = {r["finding_code"]: r for r in external_lint_findings(df, "2024-01-31 00:00:00").collect()}
    assert set(rows) == {"ZLINT_E_SUBJECT_COMMON_NAME_NOT_FROM_SAN", "ZLINT_W_BARE", "ZLINT_I_STATUS_FORM"}
    ev = json.loads(rows["ZLINT_E_SUBJECT_COMMON_NAME_NOT_FROM_SAN"]["evidence_json"])
    assert rows["ZLINT_E_SUBJECT_COMMON_NAME_NOT_FROM_SAN"]["severity"] == "medium"
    assert ev == {"details": "example", "source": "RFC 5280", "zlint_name": "e_subject_common_name_not_from_san",
                  "zlint_result": "warn", "zlint_version": "unknown"}
    assert rows["ZLINT_W_BARE"]["severity"] == "low"
    assert json.loads(rows["ZLINT_I_STATUS_FORM"]["evidence_json"])["details"] == "d"
    assert json.loads(rows["ZLINT_W_BARE"]["evidence_json"])["source"] is None


def test_results_that_are_null_or_missing(spark):
    texts = ['{"results": null, "e_outer": "error"}', '{"results": {}, "e_outer": "error"}', '{"results": "x", "e_outer": "error"}', '{"e_plain": "error"}', "not json", None]
    df = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)], "cert_hash string, result_json string")
    assert [(r.cert_hash, r.finding_code) for r in external_lint_findings(df, "2024-01-31 00:00:00").collect()] == [("h3", "ZLINT_E_PLAIN")]
