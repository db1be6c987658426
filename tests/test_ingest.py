"""Micro-batch ingest: replay, event time, pruning, version order."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from certlens.operators.latest import latest_versions
from certlens.session import ensure_checkpoint_dir, shared_path
from certlens.sources import psl, store
from certlens.streaming import ingest as Ig
from certlens.streaming import maintenance
from tests.conftest import SMOKE

TABLES = ("observations", "certificates", "cert_findings")


def halves(spark):
    """The certificate versions in two batches by time."""
    versions = spark.read.parquet(f"{store.ensure_tables(spark, SMOKE)}/certificate_versions")
    middle = versions.agg(F.percentile_approx(F.unix_micros(F.col("last_seen").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("last_seen").cast("timestamp")) <= middle
    return [versions.filter(early), versions.filter(~early)]


def written(spark, root):
    return {t: sorted(map(str, spark.read.parquet(f"{root}/{t}").collect())) for t in TABLES}


def test_replayed_batches_write_the_same_rows(spark):
    root = shared_path(spark, f"replay-{uuid.uuid4().hex[:8]}")
    batches = halves(spark)
    for i, batch in enumerate(batches):
        Ig.enrich_batch(spark, batch, root, i, rules=psl.FIXTURE_RULES)
    first = written(spark, root)
    assert all(first.values())
    for i in (0, 1):
        Ig.enrich_batch(spark, batches[i], root, i, rules=psl.FIXTURE_RULES)
        assert written(spark, root) == first


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_findings_are_stamped_with_event_time_in_any_zone(spark, monkeypatch, zone):
    root = shared_path(spark, f"zone-{uuid.uuid4().hex[:8]}")
    batch = halves(spark)[0].withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        Ig.enrich_batch(spark, batch, root, 0, rules=psl.FIXTURE_RULES)
    finally:
        monkeypatch.undo()
        time.tzset()
    newest = batch.agg(F.max("last_seen").cast("string")).first()[0]
    stamps = spark.read.parquet(f"{root}/cert_findings").select(F.col("created_at").cast("string")).distinct().collect()
    assert [r[0] for r in stamps] == [newest]


def test_prior_observations_are_pruned_by_day(spark):
    root = shared_path(spark, f"days-{uuid.uuid4().hex[:8]}")
    Ig.enrich_batch(spark, halves(spark)[0], root, 0, rules=psl.FIXTURE_RULES)
    rows = Ig.prior(spark, root, "observations", 1).filter(F.col("seen_day") >= F.lit("2024-01-10").cast("date"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "seen_day" in plan.split("PartitionFilters")[1].split("]")[0]
    assert Ig.prior(spark, root, "observations", 0) is None


def test_later_batches_win_ties_whatever_their_sequence_numbers(spark):
    rows = spark.createDataFrame([("h", 5, 0, 1 << 50, "old"), ("h", 5, 1, 3, "new")], "cert_hash string, last_seen int, batch_id int, ingest_seq long, v string")
    assert latest_versions(rows).first().v == "new"


def test_a_local_folder_is_no_default_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
    assert os.environ.get("TZ") != "Asia/Tokyo"


def test_retention_and_compaction_take_effect_for_readers(spark):
    root = shared_path(spark, f"keep-{uuid.uuid4().hex[:8]}")
    batches = halves(spark)
    for i, batch in enumerate([*batches, batches[0]]):
        Ig.enrich_batch(spark, batch, root, i, rules=psl.FIXTURE_RULES)
    columns = ["cert_hash", "last_seen", "subject_cn"]
    latest = lambda: sorted(map(str, latest_versions(spark.read.parquet(f"{root}/certificates")).select(columns).collect()))
    before, versions = latest(), spark.read.parquet(f"{root}/certificates").count()
    assert maintenance.compact_certificates(spark, root) == -1
    assert latest() == before and spark.read.parquet(f"{root}/certificates").count() < versions
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/certificates").select("batch_id").distinct().collect()) == [-1, 2]
    assert maintenance.compact_certificates(spark, root) == 0
    Ig.enrich_batch(spark, batches[1], root, 2, rules=psl.FIXTURE_RULES)  # the newest batch can still be replayed
    assert latest() == before

    days = {str(r[0]) for r in spark.read.parquet(f"{root}/observations").select("seen_day").distinct().collect()}
    assert maintenance.drop_expired_days(spark, root, "2024-01-31 00:00:00", 10)
    left = {str(r[0]) for r in spark.read.parquet(f"{root}/observations").select("seen_day").distinct().collect()}
    assert left == {d for d in days if d >= "2024-01-21"} and left != days


def test_counters_of_replayed_and_empty_batches(spark):
    """Counted as the rows pass; a replayed batch overwrites its counters; a batch whose
    events are all filtered flushes nothing."""
    from certlens.config import IssuerMatching
    from certlens.sources import adapters as A

    src = shared_path(spark, f"counted-{uuid.uuid4().hex[:8]}")
    A.der_messages(spark, SMOKE, broken=True).limit(60).coalesce(1).write.parquet(src)
    none = Ig.run_message_ingest(spark, src, matching=IssuerMatching(match_mode="issuer_dn", issuer_substrings=("no such issuer",)), rules=psl.FIXTURE_RULES)
    got = spark.read.parquet(f"{none}/counters").first()
    assert got.received_events == 60 and got.matched_events == got.flushed_observations == got.flushed_findings == 0
    assert got.filtered_events + got.processing_errors == 60 and got.processing_errors > 0


def test_touched_days_are_read_from_what_was_written(spark, monkeypatch):
    """The fan-out of a batch runs once, for the write."""
    root = shared_path(spark, f"once-{uuid.uuid4().hex[:8]}")
    plans, record = [], Ig.record_touched

    def seen(rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        record(rows, *args)

    monkeypatch.setattr(Ig, "record_touched", seen)
    Ig.enrich_batch(spark, halves(spark)[0], root, 0, rules=psl.FIXTURE_RULES)
    assert len(plans) == 1 and "Generate" not in plans[0] and "Join" not in plans[0]
    days = spark.read.parquet(f"{root}/observations").groupBy(F.to_date("seen_at").alias("day")).agg(F.count("*").alias("rows"))
    touched = spark.read.parquet(f"{root}/touched_days").filter("day is not null")
    assert sorted(map(str, touched.select("day", "rows").collect())) == sorted(map(str, days.collect())) != []
