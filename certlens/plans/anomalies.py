"""Top anomalies (G8 / H): rank, then look up evidence for the top k only.

Plan
1. newest ANOMALY_SCORE finding per certificate inside the window (an
   aggregate ``max_by`` - combines map-side, no per-key sort);
2. join the latest certificates last seen in the window, score > 0;
3. ``orderBy(score desc, last_seen desc, cert_hash).limit(k)`` - a
   TakeOrderedAndProject, so only k rows leave each partition;
4. the k keys are broadcast (size bound: k) into two semi joins that fetch
   the newest evidence ever and the severity histogram of other findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.functions.timewin import Span
from certlens.functions.unicode import with_unicode_names
from certlens.plans import reports as G
from certlens.session import materialize

SCORE = "ANOMALY_SCORE"


def _score_of(evidence: str = "evidence_json"):
    return F.coalesce(F.get_json_object(F.col(evidence), "$.anomaly_score").cast("long"), F.lit(0).cast("long"))


def newest_score_findings(findings: DataFrame, span: Span | None = None) -> DataFrame:
    """Newest ANOMALY_SCORE evidence per certificate (optionally in a window)."""
    f = findings.filter(F.col("finding_code") == SCORE)
    if span is not None:
        f = span.filter(f, "created_at", "created_day")
    return f.groupBy("cert_hash").agg(
        F.max_by("evidence_json", "created_at").alias("evidence_json"),
        F.max("created_at").alias("created_at"))


def rank_anomalies(findings: DataFrame, certificates: DataFrame, span: Span, limit: int,
                   score_source: str = "finding") -> DataFrame:
    """Steps 1-3: (cert_hash, subject_cn, dns_names, anomaly_score, last_seen, rank_evidence)."""
    certs = certificates.filter(span.contains("last_seen")).select(
        "cert_hash", "subject_cn", "dns_names", "last_seen", "anomaly_score")
    if score_source == "certificate":
        ranked = (certs.filter(F.col("anomaly_score") > 0)
                  .select("cert_hash", "subject_cn", "dns_names", "last_seen",
                          F.col("anomaly_score").cast("long").alias("anomaly_score"),
                          F.lit("").alias("rank_evidence")))
    else:
        newest = newest_score_findings(findings, span).select(
            "cert_hash", _score_of().alias("anomaly_score"), F.col("evidence_json").alias("rank_evidence"))
        ranked = (newest.filter(F.col("anomaly_score") > 0)
                  .join(certs.drop("anomaly_score"), "cert_hash"))
    return (ranked.orderBy(F.desc("anomaly_score"), F.desc("last_seen"), F.asc("cert_hash")).limit(limit))


def severity_counts(findings: DataFrame, keys: DataFrame, span: Span) -> DataFrame:
    """H5: rows per (cert, severity) of non-score findings in the window."""
    other = span.filter(findings, "created_at", "created_day").filter(F.col("finding_code") != SCORE)
    return (other.join(keys, "cert_hash", "left_semi")
            .groupBy("cert_hash", "severity").agg(F.count("*").cast("long").alias("count")))


def top_anomalies(findings: DataFrame, certificates: DataFrame, span: Span, limit: int,
                  score_source: str = "finding", unicode_names: bool = True) -> DataFrame:
    top = materialize(rank_anomalies(findings, certificates, span, limit, score_source))
    keys = top.select("cert_hash")
    evidence = newest_score_findings(findings.join(keys, "cert_hash", "left_semi")).select(
        "cert_hash", F.col("evidence_json").alias("latest_evidence"))
    sev = (severity_counts(findings, keys, span)
           .groupBy("cert_hash")
           .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "count")))))
                .alias("finding_severity_counts")))
    out = (top.join(evidence, "cert_hash", "left").join(sev, "cert_hash", "left")
           .select(
               "cert_hash", "subject_cn",
               F.slice("dns_names", 1, 5).alias("dns_names"),
               "anomaly_score", "last_seen",
               F.coalesce(F.col("latest_evidence"), F.when(F.col("rank_evidence") != "", F.col("rank_evidence")),
                          F.lit('{"top_signals": []}')).alias("evidence_json"),
               F.coalesce(F.col("finding_severity_counts"), F.lit("{}")).alias("finding_severity_counts")))
    out = out.withColumn("top_signals_json",
                         F.coalesce(F.get_json_object("evidence_json", "$.top_signals"), F.lit("[]")))
    if unicode_names:
        out = with_unicode_names(out, "dns_names", "dns_names_unicode", "cert_hash")
    return out


def anomalies_report(stats: DataFrame, findings: DataFrame, certificates: DataFrame, span: Span, limit: int, unicode_names: bool = True) -> DataFrame:
    """One row: aggregated_counts (a struct of the one-row ``stats``) and top_anomalies,
    the ranking as an array in its order (bounded by ``limit``; empty if there are none)."""
    top = top_anomalies(findings, certificates, span, limit, unicode_names=unicode_names)
    order = F.struct((-F.col("anomaly_score")).alias("s"), (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("t"), F.col("cert_hash").alias("h"),
                     F.struct(*top.columns).alias("row"))
    ranked = top.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias("top_anomalies"))
    return G.merge_single_rows(stats.select(F.struct(*stats.columns).alias("aggregated_counts")), ranked)


def report_rows(report: DataFrame) -> DataFrame:
    """A report as rows: position (from 1), the anomaly, and the counts beside each; one
    row without an anomaly if there is none."""
    each = report.select("aggregated_counts.*", F.posexplode_outer("top_anomalies").alias("at", "a"))
    counts = report.schema["aggregated_counts"].dataType.names
    return each.select((F.col("at") + 1).alias("position"), "a.cert_hash", "a.subject_cn", "a.anomaly_score", "a.finding_severity_counts", *counts)
