"""All dashboard windows in one pass against each window alone."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from certlens.catalog import AS_OF
from certlens.functions.timewin import Span
from certlens.plans import anomalies as H
from certlens.plans import reports as G
from certlens.plans import snapshots as S
from certlens.plans import windows as W
from certlens.sources import adapters as A
from tests.conftest import SMOKE

WINDOWS = [1, 7, 30]


def test_each_window_as_if_alone(spark):
    t = A.tables(spark, SMOKE)
    got = W.window_breakdowns(t.observations, t.certificates, t.findings, AS_OF, WINDOWS, ["issuer_cn", "eku_set"], 5).collect()
    for days in WINDOWS:
        for dim in ("issuer_cn", "eku_set", "finding_code", "severity", "registered_domain"):
            alone = G.breakdown(t.observations, t.certificates, t.findings, dim, Span.trailing(AS_OF, days), 5).collect()
            mine = sorted((r.rank, r.value, r["count"]) for r in got if r.days == days and r.group_by == dim)
            assert mine == [(i, r.value, r["count"]) for i, r in enumerate(alone, 1)], (days, dim)
    profiles = {r.days: r for r in W.window_profiles(t.certificates, AS_OF, WINDOWS).collect()}
    for days in WINDOWS:
        alone = G.issuer_profile(t.certificates, Span.trailing(AS_OF, days)).first()
        assert all(abs(profiles[days][c] - alone[c]) < 1e-9 for c in alone.asDict())


def test_window_edges(spark):
    at = datetime(2024, 1, 31)
    rows = [(at - timedelta(days=7),), (at - timedelta(days=7, seconds=1),), (at - timedelta(days=31),), (at + timedelta(days=1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz").withColumn("w", W.smallest_window("t", AS_OF, [30, 7]))
    assert [r.w for r in df.collect()] == [7, 30, None, 7]
    assert sorted((r.w, r.d) for r in df.select("w", W.each_window(F.col("w"), [7, 30]).alias("d")).collect()) == [(7, 7), (7, 7), (7, 30), (7, 30), (30, 30)]


def test_each_table_is_scanned_once_for_all_windows(spark):
    t = A.tables(spark, SMOKE)
    plan = W.window_breakdowns(t.observations, t.certificates, t.findings, AS_OF, [7, 30, 90, 365], S.CERT_DIMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3


def test_report_without_anomalies_keeps_its_counts(spark):
    t = A.tables(spark, SMOKE)
    stats = spark.createDataFrame([(5, 7)], "cert_count long, domain_count long")
    report = H.anomalies_report(stats, t.findings.limit(0), t.certificates, Span.trailing(AS_OF, 7), 10)
    assert report.first().top_anomalies == [] and report.first().aggregated_counts.cert_count == 5
    assert [(r.position, r.cert_hash, r.domain_count) for r in H.report_rows(report).collect()] == [(None, None, 7)]
    ranked = H.anomalies_report(stats, t.findings, t.certificates, Span.trailing(AS_OF, 30), 4).first().top_anomalies
    assert [r.cert_hash for r in ranked] == [r.cert_hash for r in H.rank_anomalies(t.findings, t.certificates, Span.trailing(AS_OF, 30), 4).collect()]
