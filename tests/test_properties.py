"""Property checks: bounded scores, range additivity, parse-once accounting."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from certlens.functions.der import DerError, parse_certificate
from certlens.functions.timewin import Span
from certlens.operators.features import extract_features
from certlens.plans import reports as G
from certlens.sources import adapters as A
from certlens.sources.dersynth import customer_certificate, integer, seq, tlv
from tests.conftest import SMOKE


def test_scores_bounded(spark):
    df = E.queries()["anomaly_score"](spark, SMOKE)
    lo, hi = df.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 <= lo <= hi <= 100


def test_daily_counts_additive_over_days(spark):
    t = A.tables(spark, SMOKE)
    whole = {tuple(r) for r in G.daily_counts(t.observations, t.certificates,
                                             Span.dates("2024-01-03", "2024-01-20")).collect()}
    left = {tuple(r) for r in G.daily_counts(t.observations, t.certificates,
                                            Span.dates("2024-01-03", "2024-01-11")).collect()}
    right = {tuple(r) for r in G.daily_counts(t.observations, t.certificates,
                                             Span.dates("2024-01-12", "2024-01-20")).collect()}
    assert whole == left | right and not (left & right)


def test_every_certificate_parsed_or_quarantined(spark):
    good_ders = [customer_certificate(k, f"Customer#{k:09d}", "BUILDING", k % 25, 1000.0 + k) for k in range(12)]
    # A truncated certificate and a bare SEQUENCE { INTEGER 0 }.
    bad = [bytes(good_ders[0][:40]), b"\x30\x03\x02\x01\x00"]
    rows = [(bytearray(d),) for d in good_ders + good_ders[:3] + bad]
    df = spark.createDataFrame(rows, "der binary")
    feats, quarantine = extract_features(df)
    assert feats.count() == 12  # distinct certificates parsed once
    assert quarantine.count() == 2
    assert feats.count() + quarantine.count() == df.select(F.sha2("der", 256)).distinct().count()


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.floats(min_value=-9999, max_value=9999, allow_nan=False))
def test_der_round_trip(key, acctbal):
    r = parse_certificate(customer_certificate(key, f"Customer#{key:09d}", "MACHINERY", key % 25, acctbal))
    assert r["serial_number"] == hex(key + 1)
    assert r["validity_days"] == int(abs(acctbal) // 12)
    assert r["san_count"] == 2 and r["subject_cn"] == f"Customer#{key:09d}"
    assert r["basic_constraints_ca"] == int(key % 29 == 0)


def test_non_positive_serial_rejected():
    cert = seq(seq(tlv(0xA0, integer(2)), integer(0)), seq(), tlv(0x03, b"\x00"))
    with pytest.raises(DerError):
        parse_certificate(cert)
