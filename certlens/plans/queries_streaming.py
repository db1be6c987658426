"""Registered streaming, ingest-envelope and rescore queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from certlens import oracle as O
from certlens.config import IssuerMatching
from certlens.session import shared_path
from certlens.catalog import AS_OF, register
from certlens.sources import adapters as A
from certlens.sources import envelope as Ev
from certlens.sources import landing
from certlens.sources import psl
from certlens.sources import store
from certlens.streaming import ingest as Ig
from certlens.streaming import stateful as St


def _landed(spark, d, late=None) -> str:
    """The observations as a feed: day after day, then late rows, then a heartbeat."""
    columns = ["seen_at", "cert_hash", "registered_domain", "issuer_key"]
    return landing.land(store.read(spark, d, "observations"), heartbeat_hours=72, late=late, columns=columns)


@register("stream_tumbling_daily", "L3", """
SELECT date_trunc('day', seen_at) AS window_start, date_trunc('day', seen_at) + INTERVAL 1 DAY AS window_end,
       issuer_key, CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count,
       CAST(count(DISTINCT registered_domain) AS BIGINT) AS domain_count, CAST(count(*) AS BIGINT) AS observations
FROM observations GROUP BY 1, 2, 3
""")
def stream_tumbling_daily(spark, d):
    return St.tumbling_daily(spark, _landed(spark, d), max_files=16)[0]


# Two late deliveries for each issuer, after all days have come: one of its newest
# hours, which the watermark has not passed, and one of its first day, which it has.
_RESENT = "SELECT issuer_key, max(seen_at) AS newest, min(seen_at) AS oldest FROM observations GROUP BY issuer_key"


@register("stream_late_rows", "L2", f"""
, resent AS ({_RESENT}),
delivered AS (SELECT seen_at, issuer_key, cert_hash, registered_domain FROM observations
              UNION ALL SELECT newest - INTERVAL 2 HOUR, issuer_key, 'cert-late', 'late.example' FROM resent)
SELECT date_trunc('day', seen_at) AS window_start, date_trunc('day', seen_at) + INTERVAL 1 DAY AS window_end,
       issuer_key, CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count,
       CAST(count(DISTINCT registered_domain) AS BIGINT) AS domain_count, CAST(count(*) AS BIGINT) AS observations,
       (SELECT CAST(count(*) AS BIGINT) FROM resent) AS late_rows
FROM delivered GROUP BY 1, 2, 3
""")
def stream_late_rows(spark, d):
    resent = store.read(spark, d, "observations").groupBy("issuer_key").agg(F.max("seen_at").alias("newest"), F.min("seen_at").alias("oldest"))
    times = F.explode(F.array(F.expr("newest - INTERVAL 2 HOURS"), F.col("oldest")))
    late = resent.select(times.alias("seen_at"), F.lit("cert-late").alias("cert_hash"), F.lit("late.example").alias("registered_domain"), "issuer_key")
    # several batches: a batch drops what was late for the one before it
    rows, dropped = St.tumbling_daily(spark, _landed(spark, d, late), max_files=8)
    return rows.withColumn("late_rows", F.lit(dropped).cast("long"))


@register("stream_burst_sliding", "L4", """
, k AS (SELECT DISTINCT date_trunc('hour', seen_at) AS h, registered_domain, cert_hash
        FROM observations WHERE registered_domain <> ''),
w AS (SELECT h - to_hours(i) AS window_start, registered_domain, cert_hash FROM k, range(0, 12) t(i))
SELECT window_start, window_start + INTERVAL 12 HOUR AS window_end, registered_domain,
       CAST(count(DISTINCT cert_hash) AS BIGINT) AS cert_count
FROM w GROUP BY 1, 2, 3
""")
def stream_burst_sliding(spark, d):
    return St.sliding_burst_counts(spark, _landed(spark, d), 12, max_files=16)


_FANOUT_SQL = O.psl_ctes("(SELECT unnest(dns_names) AS host FROM certificate_versions)") + f"""
, names AS (SELECT ingest_seq, last_seen, cert_hash, issuer_key, unnest(dns_names) AS name
            FROM certificate_versions),
per AS (SELECT n.ingest_seq, n.last_seen, n.cert_hash, n.issuer_key, r.registered_domain,
               list_sort(list_distinct(flatten(list({O.tokens_sql('n.name')})))) AS domain_tokens
        FROM names n JOIN regdom r ON r.host = n.name
        WHERE r.registered_domain <> ''
        GROUP BY 1, 2, 3, 4, 5)
SELECT last_seen AS seen_at, cert_hash, registered_domain, issuer_key, 'ct-log' AS log_id,
       'certstream' AS source, domain_tokens
FROM per
"""


@register("ingest_stream", "L1", _FANOUT_SQL)
def ingest_stream(spark, d):
    root = Ig.run_ingest(spark, f"{store.ensure_tables(spark, d)}/certificate_versions", rules=psl.FIXTURE_RULES)
    return spark.read.parquet(f"{root}/observations").drop("batch_id", "seen_day")


@register("ingest_stream_findings", "L1")
def ingest_stream_findings(spark, d):
    root = Ig.run_ingest(spark, f"{store.ensure_tables(spark, d)}/certificate_versions", rules=psl.FIXTURE_RULES)
    return spark.read.parquet(f"{root}/cert_findings").drop("batch_id")


@register("event_envelope", "A1", """
SELECT event_id, ts AS seen_at,
       CASE WHEN k % 3 = 0 THEN 'https://ct.example/' || CAST(k % 2 AS VARCHAR) ELSE 'log-' || CAST(k % 3 AS VARCHAR) END
         AS log_id,
       CASE WHEN k % 10 = 0 THEN sha256(event_type) ELSE sha256(props) END AS cert_hash,
       CAST(1 AS INTEGER) AS chain_len
FROM ev WHERE event_type IN ('view', 'click', 'purchase')
""")
def event_envelope(spark, d):
    good, _ = Ev.split_quarantine(Ev.parse_messages(A.stream_messages(spark, d)))
    return good.select("event_id", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "log_id", "cert_hash",
                       F.size("chain_der").alias("chain_len"))


MESSAGE_FAMILY = IssuerMatching(match_mode="hybrid", issuer_substrings=("building", "MACHINERY"))


@register("ingest_messages", "L1", """
SELECT e.ts AS seen_at, 'site' || CAST(c.c_custkey % 20 AS VARCHAR) || '.example' AS registered_domain,
       e.event_type AS log_id, 'certstream' AS source,
       list_sort(['www.site' || CAST(c.c_custkey % 20 AS VARCHAR) || '.example',
                  'login.site' || CAST(c.c_custkey % 20 AS VARCHAR) || '.example',
                  'site' || CAST(c.c_custkey % 20 AS VARCHAR) || '.example', 'example']) AS domain_tokens
FROM ev e JOIN customer c ON c.c_custkey = e.cert_no
WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def ingest_messages(spark, d):
    src = shared_path(spark, f"messages-{uuid.uuid4().hex[:12]}")
    A.der_messages(spark, d).repartition(8).write.parquet(src)
    root = Ig.run_message_ingest(spark, src, max_files=4, matching=MESSAGE_FAMILY, rules=psl.FIXTURE_RULES)
    return spark.read.parquet(f"{root}/observations").select(
        "seen_at", "registered_domain", "log_id", "source", "domain_tokens")


@register("ingest_counters", "A16", """
, told AS (SELECT CASE WHEN e.event_type = 'error' OR (e.event_type = 'click' AND e.k % 10 = 0) THEN 'error' WHEN e.event_type = 'signup' THEN 'filtered'
                       WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'matched' ELSE 'filtered' END AS outcome
           FROM ev e JOIN customer c ON c.c_custkey = e.cert_no)
SELECT CAST(count(*) AS BIGINT) AS received_events, CAST(count(*) FILTER (outcome <> 'error') AS BIGINT) AS processed_events,
       CAST(count(*) FILTER (outcome = 'matched') AS BIGINT) AS matched_events, CAST(count(*) FILTER (outcome = 'filtered') AS BIGINT) AS filtered_events,
       CAST(count(*) FILTER (outcome = 'error') AS BIGINT) AS processing_errors, CAST(count(*) FILTER (outcome = 'matched') AS BIGINT) AS flushed_observations
FROM told
""")
def ingest_counters(spark, d):
    """Each matched event has one registered domain, so one observation is flushed for it."""
    src = shared_path(spark, f"messages-{uuid.uuid4().hex[:12]}")
    A.der_messages(spark, d, broken=True).repartition(8).write.parquet(src)
    root = Ig.run_message_ingest(spark, src, max_files=4, matching=MESSAGE_FAMILY, rules=psl.FIXTURE_RULES)
    return spark.read.parquet(f"{root}/counters").agg(*[F.sum(c).alias(c) for c in (*Ig.COUNTERS[:5], "flushed_observations")])
