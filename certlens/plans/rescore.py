"""Rescore job (D18): recompute ANOMALY_SCORE findings for recent candidates.

Candidates are the certificates of the ANOMALY_SCORE findings in the window,
or - with ``all_certs`` - all certificates last seen in the window; a ``limit``
takes the newest findings (it counts findings; duplicates collapse afterwards)
or the first certificates by hash. Candidates meet the certificates in a semi
join (no driver round trip, no key chunks), broadcast only if Spark finds them
small. Fresh
baselines and bursts are used unless ``fast``. All new findings share one
``created_at``; stored certificate scores are not changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.config import DEFAULT, Settings
from certlens.functions.timewin import Span
from certlens.operators import baseline as B
from certlens.operators import lint as Ln
from certlens.operators import rollups as R
from certlens.operators import signals as Sg
from certlens.operators.certfeatures import attach_name_features
from certlens.sources import psl

#: The limit of the command-line job.
DEFAULT_LIMIT = 50_000


def rescore(spark: SparkSession, observations: DataFrame, certificates: DataFrame, findings: DataFrame, as_of,
            days: int, limit: int | None = None, all_certs: bool = False, fast: bool = False,
            settings: Settings = DEFAULT, *, rules: list[str]) -> DataFrame:
    span = Span.trailing(as_of, days)
    if all_certs:
        cands, order = certificates.filter(span.contains("last_seen")), [F.asc("cert_hash")]
    else:
        cands = span.filter(findings, "created_at", "created_day").filter(F.col("finding_code") == "ANOMALY_SCORE")
        order = [F.desc("created_at"), F.asc("cert_hash")]
    if limit is not None:
        cands = cands.orderBy(*order).limit(limit)
    certs = certificates.join(cands.select("cert_hash").distinct(), "cert_hash", "left_semi")
    rules_df = psl.rules_frame(spark, rules)
    t = settings.thresholds
    if fast:
        bursts, base = None, None
    else:
        bursts = B.domain_bursts(observations, as_of, t.domain_burst_window_hours)
        daily = R.daily_cert_counts(observations, certificates, R.refresh_span(as_of, days), as_of)
        base = B.baselines(observations, certificates, daily, as_of, days)
    if "issuer_key" not in certs.columns:
        from certlens.operators.issuers import issuer_key
        certs = certs.withColumn("issuer_key", issuer_key())
    feats = Ln.with_org_tokens(attach_name_features(certs, rules_df, len(rules), bursts, t.domain_burst_count))
    scored = Sg.score_certificates(Sg.attach_baseline(feats, base), settings)
    return Sg.anomaly_finding(scored, as_of)
