"""Incremental rollups: which days are replaced, reruns, restated days; and sketches
beyond their exact range."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from certlens.functions.timewin import Span
from certlens.operators import refresh as Rf
from certlens.operators import rollups as R
from certlens.operators import sketches as Sk
from certlens.sources import adapters as A
from tests.conftest import SMOKE

AS_OF = "2024-01-31 00:00:00"
SPAN = R.refresh_span(AS_OF, 30)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def rows(spark, root, table="issuer_daily_stats"):
    return sorted(map(str, spark.read.parquet(f"{root}/{table}").select("day", "issuer_key", "cert_count", "domain_count", "updated_at").collect()))


@pytest.fixture()
def tables(spark):
    return A.tables(spark, SMOKE)


def test_one_late_day_rewrites_one_day(spark, tables, tmp_path):
    root, obs = f"file://{tmp_path}/t", tables.observations
    late = F.to_date("seen_at") == F.lit("2024-01-10")
    half = late & (F.hour("seen_at") >= 12)
    Rf.record_touched(obs.filter(~half), root, 0)
    assert len(Rf.refresh_touched(obs.filter(~half), tables.certificates, root, AS_OF, SPAN)) == 30
    before = files(tmp_path / "t" / "issuer_daily_stats")
    assert Rf.refresh_touched(obs.filter(~half), tables.certificates, root, AS_OF, SPAN) == []
    assert files(tmp_path / "t" / "issuer_daily_stats") == before
    Rf.record_touched(obs.filter(half), root, 1)
    assert Rf.refresh_touched(obs, tables.certificates, root, AS_OF, SPAN) == [date(2024, 1, 10)]
    after = files(tmp_path / "t" / "issuer_daily_stats")
    changed = {f for f in before.keys() ^ after.keys()} | {f for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed and all("day=2024-01-10" in f for f in changed)
    whole = R.daily_issuer_stats(obs, tables.certificates, SPAN, AS_OF)
    assert rows(spark, root) == sorted(map(str, whole.select("day", "issuer_key", "cert_count", "domain_count", "updated_at").collect()))


def test_a_run_that_stopped_before_its_log_is_repeated(spark, tables, tmp_path, monkeypatch):
    root, obs = f"file://{tmp_path}/t", tables.observations
    Rf.record_touched(obs, root, 0)
    days, _, _ = Rf.pending_days(spark, root, SPAN)
    Rf.refresh_days(obs, tables.certificates, root, days, AS_OF)  # no log row
    first = rows(spark, root)
    assert Rf.refresh_touched(obs, tables.certificates, root, AS_OF, SPAN) == days and rows(spark, root) == first
    Rf.record_touched(obs, root, 0)  # the batch is replayed
    assert Rf.refresh_touched(obs, tables.certificates, root, AS_OF, SPAN) == []


def test_changed_certificates_restate_their_days(spark, tables, tmp_path):
    root, obs = f"file://{tmp_path}/t", tables.observations
    some = obs.join(tables.certificates, "cert_hash", "left_semi").first().cert_hash
    old = tables.certificates.withColumn("batch_id", F.lit(0))
    if "ingest_seq" not in old.columns:
        old = old.withColumn("ingest_seq", F.lit(0).cast("long"))
    new = (old.filter(F.col("cert_hash") == some).withColumn("batch_id", F.lit(1)).withColumn("has_wildcard", 1 - F.col("has_wildcard"))
           .withColumn("last_seen", F.col("last_seen") + F.expr("INTERVAL 1 DAY")))
    same = old.filter(F.col("cert_hash") != some).limit(5).withColumn("batch_id", F.lit(1))
    versions = old.unionByName(new).unionByName(same)
    assert [r[0] for r in Rf.changed_certificates(versions, 0).collect()] == [some]
    Rf.record_touched(obs, root, 0)
    Rf.refresh_touched(obs, tables.certificates, root, AS_OF, SPAN, versions.filter("batch_id = 0"))
    Rf.record_touched(obs.limit(0), root, 1)
    from certlens.operators.latest import latest_versions
    latest = latest_versions(versions)
    seen = sorted({r.seen_at.date() for r in obs.filter(F.col("cert_hash") == some).collect()})
    assert Rf.refresh_touched(obs, latest, root, AS_OF, SPAN, versions) == seen
    whole = R.daily_issuer_stats(obs, latest, SPAN, AS_OF).agg(F.sum("wildcard_count")).first()[0]
    assert spark.read.parquet(f"{root}/issuer_daily_stats").agg(F.sum("wildcard_count")).first()[0] == whole


def test_runs_do_not_grow_the_tables(spark, tables, tmp_path):
    from certlens.plans.snapshots import refresh_rollups
    root = f"file://{tmp_path}/t"
    counts = []
    for _ in range(2):
        refresh_rollups(spark, tables.observations, tables.certificates, tables.findings, root, AS_OF, 3)
        counts.append([spark.read.parquet(f"{root}/{x}").count() for x in ("issuer_daily_stats", "issuer_sigalg_stats", "dashboard_snapshots")])
    assert counts[0] == counts[1] and counts[0][2] == 1


def big(spark, n=60_000):
    """Observations and certificates of one issuer, far beyond the sketches' exact range."""
    ids = spark.range(n)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 30 * 86_400).cast("timestamp_ntz")
    obs = ids.select(at.alias("seen_at"), F.concat(F.lit("c"), "id").alias("cert_hash"), F.concat(F.lit("d"), F.col("id") % 20_000).alias("registered_domain"), F.lit("i").alias("issuer_key"))
    flags = ["has_wildcard", "has_punycode", "has_ip_san", "has_uri_san", "has_email_san", "basic_constraints_ca"]
    certs = ids.select(F.concat(F.lit("c"), "id").alias("cert_hash"), (F.col("id") % 100).cast("int").alias("anomaly_score"), (F.col("id") * 7919 % 1000).cast("int").alias("validity_days"),
                       (F.col("id") % 7).cast("int").alias("san_count"), F.array(F.lit("serverAuth")).alias("eku"), *[(F.col("id") % 3 == 0).cast("int").alias(f) for f in flags])
    return obs, certs


def test_estimates_within_their_bounds_and_merge_like_one_sketch(spark, tmp_path):
    obs, certs = big(spark)
    path = f"file://{tmp_path}/s"
    Sk.write_sketches(Sk.daily_sketches(obs, certs, SPAN), path)
    stored = Sk.read_sketches(spark, path)
    got = Sk.distinct_counts(stored).first()
    for name, exact in {"certs": 60_000, "domains": 20_000, "elevated": 42_000, "has_wildcard": 20_000, "unusual_eku": 0}.items():
        assert abs(got[name] - exact) <= Sk.COUNT_ERROR * exact, name
    assert got["certs"] != 60_000  # an estimate indeed
    for r in Sk.quantiles(stored, ["issuer_key"], "validity_days", (0.05, 0.5, 0.95)).collect():
        assert abs(r.value / 1000 - r.rank) <= Sk.RANK_ERROR + 0.001
    week = Sk.new_certificates(stored, "2024-01-24").first()
    assert abs(week.certs - 14_000) <= Sk.COUNT_ERROR * 14_000 and abs(week.new_certs - 14_000) <= 2 * Sk.COUNT_ERROR * 14_000


def test_a_window_reads_sketches_only_and_prunes_days(spark, tmp_path):
    obs, certs = big(spark, 2000)
    path = f"file://{tmp_path}/s"
    Sk.write_sketches(Sk.daily_sketches(obs, certs, SPAN), path)
    plan = Sk.distinct_counts(Sk.read_sketches(spark, path, "2024-01-05", "2024-01-08"), ["day"], ["certs"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<certs:binary>" in plan


def test_writing_a_day_again_replaces_it_alone(spark, tmp_path):
    obs, certs = big(spark, 3000)
    path = f"file://{tmp_path}/s"
    sketches = Sk.daily_sketches(obs, certs, SPAN)
    Sk.write_sketches(sketches, path)
    before = files(tmp_path / "s")
    Sk.write_sketches(sketches.filter("day = '2024-01-03'"), path)
    after = files(tmp_path / "s")
    assert all("day=2024-01-03" in f for f in before.keys() ^ after.keys()) and len(before) == len(after)
    assert Sk.distinct_counts(Sk.read_sketches(spark, path)).first().certs == 3000


def test_empty_sketch_table(spark):
    obs, certs = big(spark, 10)
    assert Sk.daily_sketches(obs.limit(0), certs, SPAN).collect() == []
    got = Sk.distinct_counts(Sk.daily_sketches(obs.limit(0), certs, SPAN)).first()
    assert got.certs == 0
    assert Span.trailing(datetime(2024, 1, 31), 1).start == datetime(2024, 1, 31) - timedelta(days=1)
