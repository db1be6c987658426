"""Dashboard snapshots (G9, G10), issuance templates (G11), recurring
findings (G12) and the rollup refresh job (F7).

A snapshot is assembled from small aggregate results: every part (stats,
profile, top lists, findings, anomalies, 12 breakdowns) is a one-row
DataFrame holding its JSON text; the parts are unioned and folded into one
payload row by a single aggregate. Nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.config import BREAKDOWN_LABELS, DASHBOARD_GROUP_BYS, DASHBOARD_WINDOWS, DEFAULT, Settings
from certlens.functions import certcols
from certlens.functions.timewin import Span, as_datetime, ts_lit
from certlens.operators.latest import latest_updated
from certlens.operators.refresh import replace_days
from certlens.operators.rollups import daily_issuer_stats, daily_sigalg_stats, refresh_span
from certlens.plans import anomalies as H
from certlens.plans import reports as G
from certlens.plans.windows import window_breakdowns, window_profiles
from certlens.session import materialize

BUCKET_SCHEMA = "struct<issuer:string,days:int,group_by:string,label:string,buckets:array<struct<value:string,count:bigint>>>"


def _sorted_buckets(col_value="value", col_count="count") -> Column:
    items = F.collect_list(F.struct(F.col(col_value).alias("value"), F.col(col_count).cast("long").alias("count")))
    return F.array_sort(items, lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1)
                        .when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))


def breakdowns_json(tops: DataFrame, days: int, issuer: str) -> DataFrame:
    """(part, json) per dimension from a (group_by, value, count, rank) frame."""
    labels = F.create_map(*[x for d, lbl in BREAKDOWN_LABELS.items() for x in (F.lit(d), F.lit(lbl))])
    return tops.groupBy("group_by").agg(_sorted_buckets().alias("buckets")).select(
        F.concat(F.lit("b:"), F.col("group_by")).alias("part"),
        F.to_json(F.struct(F.lit(issuer).alias("issuer"), F.lit(days).alias("days"), F.col("group_by"),
                           labels[F.col("group_by")].alias("label"), F.col("buckets"))).alias("json"))


def breakdown_json(top: DataFrame, group_by: str, days: int, issuer: str) -> DataFrame:
    """One row: (json) of a breakdown result in the stored payload form."""
    return top.agg(F.to_json(F.struct(
        F.lit(issuer).alias("issuer"), F.lit(days).alias("days"), F.lit(group_by).alias("group_by"),
        F.lit(BREAKDOWN_LABELS[group_by]).alias("label"), _sorted_buckets().alias("buckets"))).alias("json"))


def _profile_json(profile: DataFrame, tops: DataFrame, days: int, issuer: str) -> DataFrame:
    """Of a window's one-row profile and its breakdowns (group_by, value, count, rank)."""
    names = {"sig_alg": "top_signature_algorithms", "key_type": "top_key_types", "key_size": "top_key_sizes",
             "eku_set": "top_eku_sets", "validation_type": "top_validation_types"}
    lists = tops.filter(F.col("group_by").isin(*names) & (F.col("rank") <= 5)).groupBy("group_by").agg(_sorted_buckets().alias("b"))
    tops = lists.agg(*[F.max(F.when(F.col("group_by") == d, F.col("b"))).alias(n) for d, n in names.items()])
    row = G.merge_single_rows(profile, tops)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return row.select(F.to_json(F.struct(
        F.lit(issuer).alias("issuer"), F.lit(days).alias("days"),
        F.coalesce("cert_count", F.lit(0)).alias("cert_count"),
        F.struct(z("validity_p50").alias("p50"), z("validity_p95").alias("p95")).alias("validity_days"),
        F.struct(z("san_count_p50").alias("p50"), z("san_count_p95").alias("p95")).alias("san_count"),
        F.struct(*[z(name).alias(name) for _, name in G.PROFILE_RATES]).alias("feature_rates"),
        *[F.coalesce(F.col(n), F.array()).alias(n) for n in
          ["top_signature_algorithms", "top_key_types", "top_key_sizes", "top_eku_sets", "top_validation_types"]],
    )).alias("json"))


def _anomalies_json(findings: DataFrame, certs: DataFrame, as_of, days: int, limit: int, issuer: str) -> DataFrame:
    top = H.top_anomalies(findings, certs, Span.trailing(as_of, days), limit, unicode_names=True)
    item = F.concat(
        F.lit('{"cert_hash":'), F.to_json(F.array("cert_hash")).substr(F.lit(2), F.length(F.to_json(F.array("cert_hash"))) - 2),
        F.lit(',"subject_cn":'), F.to_json(F.array("subject_cn")).substr(F.lit(2), F.length(F.to_json(F.array("subject_cn"))) - 2),
        F.lit(',"dns_names":'), F.to_json("dns_names"),
        F.lit(',"dns_names_unicode":'), F.to_json("dns_names_unicode"),
        F.lit(',"anomaly_score":'), F.col("anomaly_score").cast("string"),
        F.lit(',"top_signals":'), F.col("top_signals_json"),
        F.lit(',"evidence":'), F.col("evidence_json"),
        F.lit(',"finding_severity_counts":'), F.col("finding_severity_counts"), F.lit("}"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("anomaly_score").alias("s"), F.col("last_seen").alias("t"),
                                                   F.col("cert_hash").alias("h"), item.alias("j"))),
                           lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1)
                           .when(a["t"] > b["t"], -1).when(a["t"] < b["t"], 1)
                           .when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    body = F.array_join(F.transform(ordered, lambda x: x["j"]), ",")
    return top.agg(F.concat(F.lit(f'{{"issuer":"{issuer}","days":{days},"limit":{limit},"top_anomalies":['),
                            F.coalesce(body, F.lit("")), F.lit("]}")).alias("json"))


CERT_DIMS = [d for d in DASHBOARD_GROUP_BYS if d not in ("finding_code", "severity", "registered_domain")]


def window_parts(observations: DataFrame, certificates: DataFrame, findings: DataFrame, as_of, windows: list[int]) -> tuple[DataFrame, DataFrame]:
    """Breakdowns and profiles of all windows, each from one pass and kept (a few rows
    a window), for the windows' payloads."""
    return (materialize(window_breakdowns(observations, certificates, findings, as_of, windows, CERT_DIMS)),
            materialize(window_profiles(certificates, as_of, windows)))


def snapshot_payload(observations: DataFrame, certificates: DataFrame, findings: DataFrame, daily_stats: DataFrame, as_of, days: int,
                     settings: Settings = DEFAULT, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row (days, payload_json, updated_at) for a window of ``days``; ``parts``
    of several windows are taken from ``window_parts``."""
    issuer = settings.issuer_label
    breakdowns, profiles = (p.filter(F.col("days") == days).drop("days") for p in parts or window_parts(observations, certificates, findings, as_of, [days]))
    stats = G.issuer_stats(daily_stats, certificates, as_of, days)
    codes = breakdowns.filter((F.col("group_by") == "finding_code") & (F.col("rank") <= 5))
    parts = [
        stats.select(F.lit("aggregated_counts").alias("part"), F.to_json(F.struct(*stats.columns)).alias("json")),
        _profile_json(profiles, breakdowns, days, issuer).select(F.lit("profile").alias("part"), "json"),
        breakdown_json(codes, "finding_code", days, issuer).select(F.lit("findings").alias("part"), "json"),
        _anomalies_json(findings, certificates, as_of, min(days, 14), 12, issuer)
        .select(F.lit("anomalies").alias("part"), "json"),
        breakdowns_json(breakdowns, days, issuer),
    ]
    unioned = reduce(lambda a, b: a.unionByName(b), parts)
    m = F.map_from_entries(F.collect_list(F.struct("part", "json")))
    stamp = as_datetime(as_of).isoformat() + "+00:00"
    pieces = [F.lit(f'{{"issuer":"{issuer}","days":{days},"updated_at":"{stamp}","aggregated_counts":'),
              m["aggregated_counts"], F.lit(',"profile":'), m["profile"], F.lit(',"findings":'), m["findings"],
              F.lit(',"anomalies":'), m["anomalies"], F.lit(',"breakdowns":{')]
    for i, dim in enumerate(DASHBOARD_GROUP_BYS):
        empty = (f'{{"issuer":"{issuer}","days":{days},"group_by":"{dim}",'
                 f'"label":"{BREAKDOWN_LABELS[dim]}","buckets":[]}}')
        pieces += [F.lit(("," if i else "") + f'"{dim}":'), F.coalesce(m[f"b:{dim}"], F.lit(empty))]
    pieces.append(F.lit("}}"))
    return unioned.agg(F.concat(*pieces).alias("payload_json")).select(
        F.lit(days).alias("days"), "payload_json", ts_lit(as_of).alias("updated_at"))


def refresh_rollups(spark: SparkSession, observations: DataFrame, certificates: DataFrame, findings: DataFrame,
                    root: str, as_of, days: int, settings: Settings = DEFAULT, align: str = "day") -> list[int]:
    """the daily and sig-alg rollups of the refresh window, then a snapshot for
    every dashboard window <= days and for ``days`` itself. Each day and each window is a
    folder that a later run replaces, so the tables do not grow with the runs."""
    span = refresh_span(as_of, days, align)
    replace_days(daily_issuer_stats(observations, certificates, span, as_of), f"{root}/issuer_daily_stats")
    replace_days(daily_sigalg_stats(observations, certificates, span, as_of), f"{root}/issuer_sigalg_stats")
    daily = spark.read.parquet(f"{root}/issuer_daily_stats")
    windows = sorted({w for w in DASHBOARD_WINDOWS if w <= days} | {days})
    windows = [w for w in windows if w > 0]
    parts = window_parts(observations, certificates, findings, as_of, windows)
    for w in windows:
        snapshot_payload(observations, certificates, findings, daily, as_of, w, settings, parts).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("days").parquet(f"{root}/dashboard_snapshots")
    return windows


def read_snapshot(spark: SparkSession, snapshots: DataFrame, observations: DataFrame, certificates: DataFrame,
                  findings: DataFrame, as_of, days: int, group_by: str, settings: Settings = DEFAULT) -> DataFrame:
    """Newest snapshot of the window with ``selected_breakdown`` = the
    stored breakdown, or a live one (limit 12) when the payload has none."""
    if group_by not in DASHBOARD_GROUP_BYS:
        raise ValueError(f"Unsupported group_by value: {group_by}")
    newest = latest_updated(snapshots.filter(F.col("days") == days), "days", ["days", "payload_json", "updated_at"])
    stored = newest.select("days", "payload_json",
                           F.get_json_object("payload_json", f"$.breakdowns.{group_by}").alias("stored"))
    flag = stored.select(F.col("stored").isNotNull().alias("has")).first()  # one boolean row
    if flag is None:
        raise ValueError(f"No dashboard snapshot available for {days}-day window. Run rollup first.")
    if flag["has"]:
        return stored.select("days", "payload_json", F.col("stored").alias("selected_breakdown"))
    live = breakdown_json(G.breakdown(observations, certificates, findings, group_by,
                                      Span.trailing(as_of, days), 12), group_by, days, settings.issuer_label)
    both = G.merge_single_rows(stored.select("days", "payload_json"), live.select(F.col("json").alias("live")))
    return both.select("days", "payload_json", F.col("live").alias("selected_breakdown"))


def selected_buckets(snapshot: DataFrame) -> DataFrame:
    """The buckets of ``selected_breakdown`` as rows (value, count)."""
    parsed = F.from_json("selected_breakdown", BUCKET_SCHEMA)
    return snapshot.select(F.explode(parsed["buckets"]).alias("b")).select("b.value", "b.count")


def _share(count: Column, total: Column) -> Column:
    pct = count.cast("double") / total.cast("double") * 100
    pct = F.when((count != total) & (pct >= 99.995), F.lit(99.99)).otherwise(pct)
    text = F.concat(F.format_number(count, 0), F.lit(" certs · "), F.format_string("%.2f", F.round(pct, 2)),
                    F.lit("%"))
    return F.when(count.isNull() | (count == 0) | total.isNull() | (total == 0), F.lit("No recent support")) \
        .otherwise(text)


def _fixed0(x: Column) -> Column:
    return F.coalesce(F.round(x, 0).cast("long"), F.lit(0)).cast("string")


def issuance_templates(daily_stats: DataFrame, certificates: DataFrame, as_of, days: int) -> DataFrame:
    """Modal issuance attributes and their share of certificates."""
    span = Span.trailing(as_of, days)
    prof = G.issuer_profile(certificates, span).select("cert_count", "validity_p50", "validity_p95",
                                                       "san_count_p50", "san_count_p95")
    firsts = []
    for dim in G.PROFILE_DIMENSIONS:
        top = G.profile_top(certificates, span, dim, 1)
        firsts.append(top.select(F.col("value").alias(f"{dim}_v"), F.col("count").alias(f"{dim}_c")))
    vc = G.issuer_stats(daily_stats, certificates, as_of, days).select(*[n for _, n in G.VALIDATION_COUNTS])
    row = G.merge_single_rows(prof, vc, *firsts)
    total = F.col("cert_count")
    cands = F.array(*[F.struct(F.coalesce(F.col(n), F.lit(0)).alias("c"), F.lit(5 - i).alias("o"),
                               F.lit(label).alias("v")) for i, (label, n) in enumerate(G.VALIDATION_COUNTS)])
    dominant = F.array_max(cands)  # greatest count, first in DV, OV, EV, Unknown order on ties
    v50, v95, s50, s95 = (F.col(c) for c in ["validity_p50", "validity_p95", "san_count_p50", "san_count_p95"])
    rows = [
        ("Signature Algorithm", F.coalesce(F.col("sig_alg_v"), F.lit("Unknown")), _share(F.col("sig_alg_c"), total)),
        ("Key Type", F.coalesce(F.col("key_type_v"), F.lit("Unknown")), _share(F.col("key_type_c"), total)),
        ("Key Size", F.when(F.col("key_size_v").isNotNull() & (F.col("key_size_v") != ""),
                            F.concat(F.col("key_size_v"), F.lit(" bits"))).otherwise("Unknown"),
         _share(F.col("key_size_c"), total)),
        ("EKU Set", F.coalesce(F.col("eku_set_v"), F.lit("Unknown")), _share(F.col("eku_set_c"), total)),
        ("Validation Type", dominant["v"], _share(dominant["c"], total)),
        ("Validity Pattern", F.when(F.coalesce(v50, F.lit(0.0)) == F.coalesce(v95, F.lit(0.0)),
                                    F.concat(_fixed0(v50), F.lit(" days")))
         .otherwise(F.concat(F.lit("p50 "), _fixed0(v50), F.lit(" days · p95 "), _fixed0(v95), F.lit(" days"))),
         F.lit("Recent baseline window")),
        ("SAN Pattern", F.when(F.coalesce(s50, F.lit(0.0)) == F.coalesce(s95, F.lit(0.0)),
                               F.concat(_fixed0(s50), F.lit(" SAN")))
         .otherwise(F.concat(F.lit("p50 "), _fixed0(s50), F.lit(" · p95 "), _fixed0(s95))),
         F.lit("Recent baseline window")),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("attribute"), v.alias("value"),
                             s.alias("support")) for i, (a, v, s) in enumerate(rows)])
    return row.select(F.explode(arr).alias("t")).select("t.*")


def recurring_findings(observations: DataFrame, certificates: DataFrame, findings: DataFrame, as_of,
                       days: int) -> DataFrame:
    """The dashboard's top-5 finding codes without ANOMALY_SCORE, with
    display labels."""
    top = G.breakdown(observations, certificates, findings, "finding_code", Span.trailing(as_of, days), 5)
    return (top.filter(F.col("value") != "ANOMALY_SCORE")
            .select("value", certcols.finding_code_label("value").alias("label"), "count"))
