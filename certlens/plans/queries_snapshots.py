"""Registered snapshot / dashboard queries (F7, G9-G12) and rescore."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from certlens import oracle as O
from certlens.catalog import AS_OF, ROLLUP_DAYS, register
from certlens.config import DASHBOARD_WINDOWS
from certlens.functions.timewin import ts_lit
from certlens.operators import refresh as Rf
from certlens.operators import rollups as R
from certlens.plans import reports as G
from certlens.plans import snapshots as S
from certlens.plans import windows as W
from certlens.plans.queries_reports import DAILY_SQL
from certlens.session import materialize, shared_path
from certlens.sources import adapters as A

SNAP_DAYS = 7


def _refreshed(spark, d, days: int):
    t = A.tables(spark, d)
    root = shared_path(spark, f"rollups-{uuid.uuid4().hex[:12]}")
    S.refresh_rollups(spark, t.observations, t.certificates, t.findings, root, AS_OF, days)
    return t, root


# The afternoon of one day is delivered after the first refresh, which the second one,
# half an hour later, has to take in.
LATE_FROM, LATE_TO = "2024-01-10 12:00:00", "2024-01-11 00:00:00"
SECOND_RUN = "2024-01-31 00:30:00"


@register("rollup_incremental", "F7", f"""
, rolled AS ({DAILY_SQL})
SELECT * REPLACE (CASE WHEN day IN (SELECT CAST(seen_at AS DATE) FROM observations WHERE seen_at >= {O.ts(LATE_FROM)} AND seen_at < {O.ts(LATE_TO)})
                  THEN {O.ts(SECOND_RUN)} ELSE updated_at END AS updated_at)
FROM rolled
""")
def rollup_incremental(spark, d):
    t = A.tables(spark, d)
    root = shared_path(spark, f"refresh-{uuid.uuid4().hex}")
    late = (F.col("seen_at") >= ts_lit(LATE_FROM)) & (F.col("seen_at") < ts_lit(LATE_TO))
    span = R.refresh_span(AS_OF, ROLLUP_DAYS)
    first = t.observations.filter(~late)
    Rf.record_touched(first, root, 0)
    Rf.refresh_touched(first, t.certificates, root, AS_OF, span)
    Rf.record_touched(t.observations.filter(late), root, 1)
    Rf.refresh_touched(t.observations, t.certificates, root, SECOND_RUN, span)
    return spark.read.parquet(f"{root}/issuer_daily_stats")


@register("snapshot_build", "G9")
def snapshot_build(spark, d):
    t = A.tables(spark, d)
    daily = R.daily_issuer_stats(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)
    return S.snapshot_payload(t.observations, t.certificates, t.findings, daily, AS_OF, SNAP_DAYS)


_VALUES = {dim: O.DIM_SQL[dim] for dim in S.CERT_DIMS}


def _counts_sql(days: int) -> str:
    """(days, group_by, value, count) of one window, uncut."""
    parts = [f"SELECT {days} AS days, '{dim}' AS group_by, {value} AS value, count(*) AS count FROM certificates WHERE {O.trailing('last_seen', days)} GROUP BY 3"
             for dim, value in _VALUES.items()]
    parts += [f"SELECT {days}, '{dim}', {dim}, count(DISTINCT cert_hash) FROM cert_findings WHERE {O.trailing('created_at', days)} AND {dim} <> '' GROUP BY 3" for dim in ("finding_code", "severity")]
    parts.append(f"SELECT {days}, 'registered_domain', registered_domain, count(DISTINCT cert_hash) FROM observations WHERE {O.trailing('seen_at', days)} GROUP BY 3")
    return " UNION ALL ".join(parts)


def _top_sql(days: list[int]) -> str:
    return f"""
, counts AS ({' UNION ALL '.join(map(_counts_sql, days))}),
tops AS (SELECT days, group_by, value, CAST(count AS BIGINT) AS count, CAST(row_number() OVER (PARTITION BY days, group_by ORDER BY count DESC, value) AS INTEGER) AS rank FROM counts)
"""


@register("snapshot_windows", "G9", _top_sql(DASHBOARD_WINDOWS) + "SELECT * FROM tops WHERE rank <= 12")
def snapshot_windows(spark, d):
    t = A.tables(spark, d)
    return W.window_breakdowns(t.observations, t.certificates, t.findings, AS_OF, DASHBOARD_WINDOWS, S.CERT_DIMS)


_PROFILE_SQL = ", ".join(f"avg({flag}) AS {name}" for flag, name in G.PROFILE_RATES)


@register("snapshot_profiles", "G9", " UNION ALL ".join(
    f"SELECT {days} AS days, CAST(count(*) AS BIGINT) AS cert_count, quantile_cont(validity_days, 0.5) AS validity_p50, quantile_cont(validity_days, 0.95) AS validity_p95, "
    f"quantile_cont(san_count, 0.5) AS san_count_p50, quantile_cont(san_count, 0.95) AS san_count_p95, {_PROFILE_SQL} FROM certificates WHERE {O.trailing('last_seen', days)}"
    for days in DASHBOARD_WINDOWS))
def snapshot_profiles(spark, d):
    return W.window_profiles(A.certificates(spark, d), AS_OF, DASHBOARD_WINDOWS)


_LISTS = {"sig_alg": "top_signature_algorithms", "key_type": "top_key_types", "key_size": "top_key_sizes", "eku_set": "top_eku_sets", "validation_type": "top_validation_types"}
_SUMS = [c for c in R.DAILY_COUNTERS]


@register("snapshot_parts", "G9", _top_sql([SNAP_DAYS]) + f"""
, rolled AS ({DAILY_SQL}),
sums AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in _SUMS)} FROM rolled WHERE day >= CAST({O.AS_OF} AS DATE) - INTERVAL {SNAP_DAYS} DAY),
kinds AS (SELECT {', '.join(f"count(*) FILTER (vt = '{label}') AS {name}" for label, name in G.VALIDATION_COUNTS)}
          FROM (SELECT {O.VALIDATION_SQL} AS vt FROM certificates WHERE {O.trailing('last_seen', SNAP_DAYS)}) x),
scored AS (
  SELECT cert_hash, CAST(json_extract_string(arg_max(evidence_json, created_at), '$.anomaly_score') AS BIGINT) AS score
  FROM cert_findings WHERE finding_code = 'ANOMALY_SCORE' AND {O.trailing('created_at', SNAP_DAYS)} GROUP BY 1),
best AS (SELECT cert_hash, score FROM scored JOIN certificates USING (cert_hash) WHERE score > 0 AND {O.trailing('last_seen', SNAP_DAYS)}
         ORDER BY score DESC, last_seen DESC, cert_hash LIMIT 12)
SELECT 'breakdowns.' || group_by AS part, value, count FROM tops WHERE rank <= 12
UNION ALL SELECT 'findings', value, count FROM tops WHERE rank <= 5 AND group_by = 'finding_code'
UNION ALL SELECT 'profile.' || CASE group_by {' '.join(f"WHEN '{dim}' THEN '{name}'" for dim, name in _LISTS.items())} END, value, count
          FROM tops WHERE rank <= 5 AND group_by IN ({', '.join(f"'{dim}'" for dim in _LISTS)})
{' '.join(f"UNION ALL SELECT 'aggregated_counts', '{c}', CAST({c} AS BIGINT) FROM sums" for c in _SUMS)}
{' '.join(f"UNION ALL SELECT 'aggregated_counts', '{name}', CAST({name} AS BIGINT) FROM kinds" for _, name in G.VALIDATION_COUNTS)}
UNION ALL SELECT 'profile', 'cert_count', CAST(count(*) AS BIGINT) FROM certificates WHERE {O.trailing('last_seen', SNAP_DAYS)}
UNION ALL SELECT 'anomalies', cert_hash, score FROM best
""")
def snapshot_parts(spark, d):
    """The stored payload, read back part by part as (part, value, count) rows."""
    t, root = _refreshed(spark, d, SNAP_DAYS)
    stored = spark.read.parquet(f"{root}/dashboard_snapshots").select("payload_json")
    buckets = "array<struct<value:string,count:bigint>>"
    schema = ("aggregated_counts map<string,bigint>, findings struct<buckets:" + buckets + ">, breakdowns map<string,struct<buckets:" + buckets + ">>, "
              + "anomalies struct<top_anomalies:array<struct<cert_hash:string,anomaly_score:bigint>>>, "
              + "profile struct<cert_count:bigint," + ",".join(f"{name}:{buckets}" for name in _LISTS.values()) + ">")
    p = materialize(stored.select(F.from_json("payload_json", schema).alias("p")).select("p.*"))
    rows = lambda part, df: df.select(part.alias("part"), F.col("b.value").alias("value"), F.col("b.count").alias("count"))
    out = rows(F.concat(F.lit("breakdowns."), F.col("key")), p.select(F.explode("breakdowns")).select("key", F.explode("value.buckets").alias("b")))
    out = out.unionByName(rows(F.lit("findings"), p.select(F.explode("findings.buckets").alias("b"))))
    for name in _LISTS.values():
        out = out.unionByName(rows(F.lit(f"profile.{name}"), p.select(F.explode(f"profile.{name}").alias("b"))))
    out = out.unionByName(p.select(F.explode("aggregated_counts")).select(F.lit("aggregated_counts").alias("part"), F.col("key").alias("value"), F.col("value").alias("count")))
    out = out.unionByName(p.select(F.lit("profile").alias("part"), F.lit("cert_count").alias("value"), F.col("profile.cert_count").alias("count")))
    best = p.select(F.explode("anomalies.top_anomalies").alias("a"))
    return out.unionByName(best.select(F.lit("anomalies").alias("part"), F.col("a.cert_hash").alias("value"), F.col("a.anomaly_score").alias("count")))


@register("snapshot_latest", "G10", f"""
SELECT value, count FROM (
  SELECT issuer_cn AS value, CAST(count(*) AS BIGINT) AS count FROM certificates
  WHERE {O.trailing('last_seen', SNAP_DAYS)} GROUP BY 1) t
ORDER BY count DESC, value ASC LIMIT 12
""")
def snapshot_latest(spark, d):
    t, root = _refreshed(spark, d, SNAP_DAYS)
    snaps = spark.read.parquet(f"{root}/dashboard_snapshots")
    snap = S.read_snapshot(spark, snaps, t.observations, t.certificates, t.findings, AS_OF, SNAP_DAYS, "issuer_cn")
    return S.selected_buckets(snap)


def _share_sql(c: str, total: str) -> str:
    pct = f"(CAST({c} AS DOUBLE) / CAST({total} AS DOUBLE) * 100)"
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 OR {total} IS NULL OR {total} = 0 THEN 'No recent support' "
            f"ELSE format('{{:,}}', {c}) || ' certs · ' || printf('%.2f', round(CASE WHEN {c} <> {total} "
            f"AND {pct} >= 99.995 THEN 99.99 ELSE {pct} END, 2)) || '%' END")


def _fixed0_sql(x: str) -> str:
    return f"CAST(CAST(round(coalesce({x}, 0.0)) AS BIGINT) AS VARCHAR)"


def _top1(dim: str) -> str:
    return (f"(SELECT {O.DIM_SQL[dim]} AS v, count(*) AS c FROM certificates WHERE {O.trailing('last_seen', ROLLUP_DAYS)}"
            f" GROUP BY 1 ORDER BY c DESC, v ASC LIMIT 1)")


@register("issuance_templates", "G11", f"""
, prof AS (SELECT count(*) AS cert_count, quantile_cont(validity_days, 0.5) AS v50,
                  quantile_cont(validity_days, 0.95) AS v95, quantile_cont(san_count, 0.5) AS s50,
                  quantile_cont(san_count, 0.95) AS s95
           FROM certificates WHERE {O.trailing('last_seen', ROLLUP_DAYS)}),
t_sig AS {_top1('sig_alg')}, t_kt AS {_top1('key_type')}, t_ks AS {_top1('key_size')}, t_eku AS {_top1('eku_set')},
vt AS (SELECT {O.VALIDATION_SQL} AS vt FROM certificates WHERE {O.trailing('last_seen', ROLLUP_DAYS)}),
cand AS (SELECT * FROM (VALUES ('DV', 5), ('OV', 4), ('EV', 3), ('Unknown', 2)) x(v, o)),
dom AS (SELECT cand.v, (SELECT count(*) FROM vt WHERE vt.vt = cand.v) AS c, o FROM cand
        ORDER BY c DESC, o DESC LIMIT 1)
SELECT 0 AS position, 'Signature Algorithm' AS attribute, coalesce((SELECT v FROM t_sig), 'Unknown') AS value,
       {_share_sql('(SELECT c FROM t_sig)', '(SELECT cert_count FROM prof)')} AS support
UNION ALL SELECT 1, 'Key Type', coalesce((SELECT v FROM t_kt), 'Unknown'),
       {_share_sql('(SELECT c FROM t_kt)', '(SELECT cert_count FROM prof)')}
UNION ALL SELECT 2, 'Key Size', coalesce((SELECT v FROM t_ks) || ' bits', 'Unknown'),
       {_share_sql('(SELECT c FROM t_ks)', '(SELECT cert_count FROM prof)')}
UNION ALL SELECT 3, 'EKU Set', coalesce((SELECT v FROM t_eku), 'Unknown'),
       {_share_sql('(SELECT c FROM t_eku)', '(SELECT cert_count FROM prof)')}
UNION ALL SELECT 4, 'Validation Type', (SELECT v FROM dom),
       {_share_sql('(SELECT c FROM dom)', '(SELECT cert_count FROM prof)')}
UNION ALL SELECT 5, 'Validity Pattern',
       CASE WHEN coalesce(v50, 0.0) = coalesce(v95, 0.0) THEN {_fixed0_sql('v50')} || ' days'
            ELSE 'p50 ' || {_fixed0_sql('v50')} || ' days · p95 ' || {_fixed0_sql('v95')} || ' days' END,
       'Recent baseline window' FROM prof
UNION ALL SELECT 6, 'SAN Pattern',
       CASE WHEN coalesce(s50, 0.0) = coalesce(s95, 0.0) THEN {_fixed0_sql('s50')} || ' SAN'
            ELSE 'p50 ' || {_fixed0_sql('s50')} || ' · p95 ' || {_fixed0_sql('s95')} END,
       'Recent baseline window' FROM prof
""")
def issuance_templates(spark, d):
    t = A.tables(spark, d)
    daily = R.daily_issuer_stats(t.observations, t.certificates, R.refresh_span(AS_OF, ROLLUP_DAYS), AS_OF)
    return S.issuance_templates(daily, t.certificates, AS_OF, ROLLUP_DAYS)


@register("recurring_findings", "G12", f"""
SELECT value, replace(lower(value), '_', ' ') AS label, count FROM (
  SELECT finding_code AS value, CAST(count(DISTINCT cert_hash) AS BIGINT) AS count FROM cert_findings
  WHERE {O.trailing('created_at', 14)} AND finding_code <> '' GROUP BY 1
  ORDER BY count DESC, value ASC LIMIT 5) t
WHERE value <> 'ANOMALY_SCORE'
""")
def recurring_findings(spark, d):
    t = A.tables(spark, d)
    return S.recurring_findings(t.observations, t.certificates, t.findings, AS_OF, 14)
