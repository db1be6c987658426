"""Unbounded enrichment pipeline (L1): certificate events -> the three tables.

Each micro-batch (``foreachBatch``):
1. newest version per certificate inside the batch (A12) -> certificates;
2. observation fan-out of every event (A11) -> observations;
3. lint findings (C) and the ANOMALY_SCORE finding (D), scored against
   baselines and bursts of the tables *before* this batch is appended (so a
   certificate's own sightings do not count towards its burst);
4. writes certificates, observations, findings in that order into folders
   named by the batch id (overwrite = idempotent on replay), observations by day.

A batch reads only what batches before it have written, and its time is the
newest event's, so a replayed batch writes the same rows again.
"""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from certlens.config import DEFAULT, IssuerMatching, Settings
from certlens.functions.timewin import as_datetime, date_lit, ts_lit
from certlens.functions.unicode import spki_hash_udf
from certlens.operators import baseline as B
from certlens.operators import lint as Ln
from certlens.operators import rollups as R
from certlens.operators import signals as Sg
from certlens.operators.certfeatures import attach_name_features
from certlens.operators.latest import dedupe_batch, latest_versions
from certlens.operators.observations import observation_fanout
from certlens.operators.refresh import record_touched
from certlens.session import shared_path
from certlens.sources import psl
from certlens.streaming.jobs import file_stream, run_batches

TABLES = ("certificates", "observations", "cert_findings")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolving the path is the check
        return True
    except Exception:  # noqa: BLE001 - missing / empty folder
        return False


BASELINE_TTL_SECONDS = 300


def prior(spark: SparkSession, root: str, table: str, batch_id: int) -> DataFrame | None:
    """What the batches before ``batch_id`` have written to a table."""
    path = f"{root}/{table}"
    if not _exists(spark, path):
        return None
    rows = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
    return None if rows.isEmpty() else rows


def stored_baselines(spark: SparkSession, root: str, batch_id: int, as_of, settings: Settings = DEFAULT,
                     ttl_seconds: int = BASELINE_TTL_SECONDS) -> DataFrame:
    """F8: issuer baselines, recomputed at most once per ``ttl_seconds`` of event
    time. Each computed set is a folder named by its batch; a batch takes the
    newest one of earlier batches that is young enough, else writes its own. A
    replayed batch finds the same folders, so it scores the same."""
    fresh = ts_lit(as_datetime(as_of) - timedelta(seconds=ttl_seconds))
    before = prior(spark, root, "baselines", batch_id)
    if before is not None:
        usable = before.filter(F.col("baseline_as_of") > fresh)
        newest = usable.agg(F.max("batch_id")).first()[0]
        if newest is not None:
            return usable.filter(F.col("batch_id") == newest).drop("batch_id", "baseline_as_of")
    days = settings.window_days
    since = as_datetime(as_of) - timedelta(days=days)
    obs = prior(spark, root, "observations", batch_id).filter(F.col("seen_day") >= date_lit(since))
    certs = prior(spark, root, "certificates", batch_id)
    certs = latest_versions(certs.join(obs.select("cert_hash").distinct(), "cert_hash", "left_semi"))
    daily = R.daily_cert_counts(obs, certs, R.refresh_span(as_of, days), as_of)
    base = B.baselines(obs, certs, daily, as_of, days).withColumn("baseline_as_of", ts_lit(as_of))
    path = f"{root}/baselines/batch_id={batch_id}"
    base.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("baseline_as_of")


def enrich_batch(spark: SparkSession, batch: DataFrame, root: str, batch_id: int,
                 settings: Settings = DEFAULT, *, rules: list[str]) -> dict[str, int]:
    """Steps 1 to 4 for one batch; returns the rows written to each table, which are
    observed while they are written."""
    t = settings.thresholds
    rules_df = psl.rules_frame(spark, rules)
    # The micro-batch feeds three outputs: persist it (and the scored rows)
    # once instead of recomputing per write; both are released at the end.
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    # The batch's event time as text in the session's zone (UTC): a timestamp
    # value would come back in the driver's own zone.
    as_of = batch.agg(F.max("last_seen").cast("string")).first()[0]
    if as_of is None:
        batch.unpersist()
        return {}
    events = batch.select(F.col("ingest_seq").alias("event_id"), F.col("last_seen").alias("seen_at"), "cert_hash",
                          "issuer_key", F.coalesce(F.col("log_id") if "log_id" in batch.columns else F.lit(None),
                                                   F.lit("ct-log")).alias("log_id"), "dns_names")
    certs = dedupe_batch(batch.drop("log_id") if "log_id" in batch.columns else batch)
    obs = observation_fanout(events, rules_df, len(rules))

    prior_obs = prior(spark, root, "observations", batch_id)
    if prior_obs is not None:
        first_day = as_datetime(as_of) - timedelta(hours=t.domain_burst_window_hours)
        recent = prior_obs.filter(F.col("seen_day") >= date_lit(first_day))
        bursts = B.domain_bursts(recent, as_of, t.domain_burst_window_hours)
        base = stored_baselines(spark, root, batch_id, as_of, settings)
    else:
        bursts, base = None, None
    feats = attach_name_features(certs, rules_df, len(rules), bursts, t.domain_burst_count)
    feats = Ln.with_org_tokens(feats)
    scored = Sg.score_certificates(Sg.attach_baseline(feats, base), settings).persist(StorageLevel.MEMORY_AND_DISK)
    findings = Ln.lint_findings(scored, as_of, settings).unionByName(Sg.anomaly_finding(scored, as_of))
    stored_certs = scored.select(*[c for c in batch.columns if c != "log_id" and c != "anomaly_score"],
                                 "anomaly_score")
    by_day = obs.withColumn("seen_day", F.to_date("seen_at"))
    flushed = {}
    for name, rows, folders in (("certificates", stored_certs, []), ("observations", by_day, ["seen_day"]), ("findings", findings, [])):
        count = Observation()
        table = "cert_findings" if name == "findings" else name
        rows.observe(count, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*folders).parquet(f"{root}/{table}/batch_id={batch_id}")
        flushed[name] = count.get["n"]
    # the days of what was written, so that the fan-out runs once
    record_touched(spark.read.schema(by_day.schema).parquet(f"{root}/observations/batch_id={batch_id}"), root, batch_id)
    scored.unpersist()
    batch.unpersist()
    return flushed


def events_from_messages(spark: SparkSession, messages: DataFrame, known_versions: DataFrame | None, matching: IssuerMatching = IssuerMatching(),
                         counters: tuple[Observation, Observation] | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw messages -> (certificate version rows with log_id, quarantine).

    A1-A5 envelope, A8 features parsed once per distinct certificate not yet
    known (known ones reuse their stored features), A7 issuer SPKI hash from
    the first chain certificate (distinct values only), A9 issuer-family
    filter, A10 issuer key. ``counters`` observe the events (A16): as messages, and
    where the issuer filter decides (matched_events, others, unparsable)."""
    from certlens.operators.features import extract_features
    from certlens.operators.issuers import issuer_key, issuer_matches
    from certlens.sources.envelope import parse_messages, split_quarantine

    good, bad_msgs = split_quarantine(parse_messages(messages, counters=counters[0] if counters else None))
    events = good.select("seen_at", "log_id", "cert_hash", F.col("leaf_der").alias("der"),
                         F.element_at(F.col("chain_der"), 1).alias("chain0"))
    known = None
    if known_versions is not None:  # of all history, only the batch's own certificates are aggregated
        keys = events.select("cert_hash").distinct()
        known = latest_versions(known_versions.join(keys, "cert_hash", "left_semi")).drop("batch_id")
    new_feats, bad_certs = extract_features(events.select("der"), known, once=True)
    feats = new_feats if known is None else new_feats.unionByName(known.select(*new_feats.columns))
    chains = events.select("chain0").where(F.col("chain0").isNotNull()).distinct()
    spki = chains.select("chain0", spki_hash_udf("chain0").alias("issuer_spki_hash"))
    rows = events.join(spki, "chain0", "left").join(feats.withColumn("parsed", F.lit(True)), "cert_hash", "left")
    parsed, matches = F.coalesce("parsed", F.lit(False)), F.coalesce(issuer_matches(matching), F.lit(False))
    rows = rows.withColumn("issuer_key", issuer_key()).withColumn("matches", parsed & matches)
    if counters:
        rows = rows.observe(counters[1], F.count(F.when(F.col("matches"), 1)).alias("matched_events"), F.count(F.when(parsed & ~F.col("matches"), 1)).alias("others"),
                            F.count(F.when(~parsed, 1)).alias("unparsable"))
    rows = rows.filter("matches").select(
        *[c for c in new_feats.columns], "issuer_spki_hash", "issuer_key", "log_id",
        F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
        F.lit(0).alias("anomaly_score"),
        F.monotonically_increasing_id().alias("ingest_seq"))
    quarantine = bad_msgs.select(F.lit(None).cast("string").alias("cert_hash"), "error").unionByName(bad_certs)
    return rows, quarantine


COUNTERS = ("received_events", "processed_events", "matched_events", "filtered_events", "processing_errors",
            "flushed_certificates", "flushed_observations", "flushed_findings")


def batch_counters(messages: dict, events: dict, flushed: dict) -> dict[str, int]:
    """One batch's counters from what was observed as its rows passed. An event
    without a leaf or of another issuer family is filtered; one that can't be decoded or
    parsed is an error; the others match."""
    errors = messages["undecodable"] + events["unparsable"]
    filtered = messages["no_leaf"] + events["others"]
    return {"received_events": messages["received_events"], "processed_events": messages["received_events"] - errors,
            "matched_events": events["matched_events"], "filtered_events": filtered, "processing_errors": errors,
            **{f"flushed_{name}": flushed.get(name, 0) for name in ("certificates", "observations", "findings")}}


def run_message_ingest(spark: SparkSession, source_dir: str, root: str | None = None,
                       max_files: int | None = None, settings: Settings = DEFAULT,
                       matching: IssuerMatching | None = None, available_now: bool = True, *, rules: list[str]) -> str:
    """L1 from raw messages: a stream over a folder of message rows (a
    ``value`` column of JSON text) into the three tables plus quarantine."""
    root = root or shared_path(spark, f"ingest-{uuid.uuid4().hex[:12]}")
    match = matching or settings.matching

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = prior(spark, root, "certificates", batch_id)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        seen = Observation(), Observation()
        rows, quarantine = events_from_messages(spark, batch, known, match, seen)
        flushed = enrich_batch(spark, rows, root, batch_id, settings, rules=rules)
        quarantine.write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")
        counted = batch_counters(seen[0].get, seen[1].get, flushed)
        row = spark.createDataFrame([tuple(counted[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
        row.coalesce(1).write.mode("overwrite").parquet(f"{root}/counters/batch_id={batch_id}")
        batch.unpersist()

    run_batches(file_stream(spark, source_dir, max_files), handle, os.path.join(root, "_checkpoint"),
                available_now=available_now)
    return root


def run_ingest(spark: SparkSession, source_dir: str, root: str | None = None, max_files: int | None = None,
               settings: Settings = DEFAULT, available_now: bool = True, *, rules: list[str]) -> str:
    """Run the enrichment stream over a folder of parsed certificate events
    (certificate columns + issuer_key + ingest_seq). Returns the tables root."""
    root = root or shared_path(spark, f"ingest-{uuid.uuid4().hex[:12]}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        enrich_batch(spark, batch, root, batch_id, settings, rules=rules)

    run_batches(file_stream(spark, source_dir, max_files), handle, os.path.join(root, "_checkpoint"),
                available_now=available_now)
    return root
