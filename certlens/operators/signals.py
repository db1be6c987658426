"""Anomaly signals (D), score and top signals (D16), ANOMALY_SCORE finding.

Certificates carry their name features, the issuer baseline (left join on
issuer_key: one row per issuer) and their burst matches. The 15 signals
are one array of optional structs in emission order; the score and the top
three are computed with array higher-order functions - no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.config import DEFAULT, Settings
from certlens.functions.timewin import ts_lit
from certlens.operators.lint import _json, org_columns, with_rule_inputs


def _signal(ordinal: int, code: str, severity: Column, score: int, cond: Column, evidence: Column) -> Column:
    return F.when(cond, F.struct(F.lit(ordinal).alias("ordinal"), F.lit(code).alias("code"),
                                 severity.alias("severity"), F.lit(score).alias("score"),
                                 evidence.alias("evidence_json")))


def _entropy_matches(threshold: float):
    """(all matches, punycode matches) over every SAN, as in the original:
    punycode names count only when confusable (first 10) and are measured on
    their decoded form."""
    info = F.col("name_info")
    conf_names = F.col("_conf_names")

    def measure(x):
        keep = ~x["puny"] | F.array_contains(conf_names, x["name"])
        return F.struct(keep.alias("keep"), x["puny"].alias("puny"), x["entropy"].alias("e"), x["name"].alias("san"))

    measured = F.transform(info, measure)
    return F.filter(measured, lambda m: m["keep"] & (m["e"] >= threshold))


def with_signal_inputs(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per-row inputs shared by several signals, each in its own projection
    (so a value referenced by a condition and its evidence is computed once)."""
    t = settings.thresholds
    first10 = F.filter(F.slice(F.col("name_info"), 1, 10), lambda x: x["confusable_json"].isNotNull())
    out = with_rule_inputs(df)
    out = out.withColumns({
        "_conf_names": F.transform(first10, lambda x: x["name"]),
        "_confs": F.transform(first10, lambda x: x["confusable_json"]),
        "_keywords": F.array_sort(F.array_distinct(F.flatten(F.filter(
            F.transform(F.col("name_info"), lambda x: x["keywords"]), lambda k: k.isNotNull())))),
        "_outlier": F.coalesce(F.col("validity_p95").isNotNull() & (F.col("validity_p95") != 0)
                               & (F.col("validity_days") > F.col("validity_p95")), F.lit(False)),
    })
    out = out.withColumn("_hits", _entropy_matches(t.high_entropy_threshold))
    as_match = lambda m: F.struct(F.round(m["e"], 3).alias("entropy"), m["san"].alias("san"))
    return out.withColumns({"_ent_all": F.transform("_hits", as_match),
                            "_ent_puny": F.transform(F.filter("_hits", lambda m: m["puny"]), as_match)})


def signal_array(settings: Settings = DEFAULT) -> Column:
    t, w = settings.thresholds, settings.weights
    c = F.col
    o = org_columns()
    ovev = c("validation_type").isin("OV", "EV")
    has_org = c("subject_org") != ""
    names5 = F.slice(c("dns_names"), 1, 5)
    ent_all, ent_puny = c("_ent_all"), c("_ent_puny")
    confusables = c("_confs")
    keywords = c("_keywords")
    bursts = c("burst_matches")
    p95 = c("validity_p95")
    outlier = c("_outlier")
    rare = (c("has_ip_san") != 0) | (c("has_uri_san") != 0) | (c("has_email_san") != 0)
    eku_key = F.array_join(F.array_sort(c("eku")), ",")
    sets = c("common_eku_sets")
    avg = c("trailing_daily_avg")
    return F.array(
        _signal(1, "high_san_count", F.lit("medium"), w.high_san, c("san_count") >= t.high_san_count,
                _json(san_count=c("san_count"), threshold=F.lit(t.high_san_count))),
        _signal(2, "wildcard_san",
                F.when(c("wildcard_rate") < t.wildcard_baseline_rate, "medium").otherwise("info"),
                w.wildcard, c("has_wildcard") != 0, _json(dns_names=names5)),
        _signal(3, "org_domain_mismatch", F.when(ovev, "medium").otherwise("info"), w.org_domain_mismatch,
                has_org & (F.size(o["org"]) > 0) & (F.size(o["dom"]) > 0) & o["disjoint"],
                _json(subject_org=c("subject_org"), org_tokens=o["org"], domain_tokens=o["dom"],
                      validation_type=c("validation_type"))),
        _signal(4, "brand_org_impersonation", F.when(ovev, "high").otherwise("medium"), w.brand_org_impersonation,
                has_org & (F.size(o["brands"]) > 0) & o["disjoint"],
                _json(subject_org=c("subject_org"), brand_matches=o["brands"], domain_tokens=o["dom"],
                      validation_type=c("validation_type"))),
        _signal(5, "registered_domain_burst",
                F.when(F.try_element_at(bursts, F.lit(1))["cert_count"] >= t.domain_burst_count * 2, "high")
                .otherwise("medium"),
                w.domain_burst, F.size(bursts) > 0,
                _json(matches=F.slice(bursts, 1, 5), threshold=F.lit(t.domain_burst_count),
                      window_hours=F.lit(t.domain_burst_window_hours))),
        _signal(6, "high_entropy_label", F.lit("medium"), w.entropy, F.size(ent_all) > 0,
                _json(matches=F.slice(ent_all, 1, 5), threshold=F.lit(t.high_entropy_threshold))),
        _signal(7, "idn_confusable", F.lit("medium"), w.idn_confusable, F.size(confusables) > 0,
                F.concat(F.lit('{"matches":['), F.array_join(F.slice(confusables, 1, 5), ","), F.lit("]}"))),
        _signal(8, "punycode_san",
                F.when(c("punycode_rate") < t.punycode_baseline_rate, "low").otherwise("info"),
                max(2, w.punycode // 4), c("has_punycode") != 0, _json(dns_names=names5)),
        _signal(9, "punycode_entropy_combo", F.lit("medium"), max(w.punycode, w.entropy),
                (c("has_punycode") != 0) & (F.size(ent_puny) > 0),
                _json(dns_names=names5, matches=F.slice(ent_puny, 1, 5), threshold=F.lit(t.high_entropy_threshold))),
        _signal(10, "suspicious_keywords", F.lit("info"), w.keyword, F.size(keywords) > 0, _json(keywords=keywords)),
        _signal(11, "validity_outlier", F.lit("medium"), w.validity, outlier,
                _json(validity_days=c("validity_days"), baseline_p95=p95)),
        _signal(12, "validity_long", F.lit("medium"), w.validity,
                ~outlier & (c("validity_days") > t.medium_validity_days),
                _json(validity_days=c("validity_days"))),
        _signal(13, "rare_san_types", F.lit("medium"), w.extension, rare,
                F.to_json(F.struct(F.when(c("has_email_san") != 0, F.lit(True)).alias("has_email_san"),
                                   F.when(c("has_ip_san") != 0, F.lit(True)).alias("has_ip_san"),
                                   F.when(c("has_uri_san") != 0, F.lit(True)).alias("has_uri_san")))),
        _signal(14, "unusual_eku_set", F.lit("medium"), w.eku,
                c("has_baseline") & (F.size(c("eku")) > 0) & (F.size(F.coalesce(sets, F.array())) > 0)
                & ~F.array_contains(F.coalesce(sets, F.array().cast("array<string>")), eku_key),
                _json(eku=c("eku"))),
        _signal(15, "issuer_spike", F.lit("high"), w.spike,
                avg.isNotNull() & (avg != 0) & (c("current_day_count") > avg * t.spike_multiplier),
                _json(current_day_count=c("current_day_count"), trailing_daily_avg=F.round(avg, 2))),
    )


BASELINE_COLS = {
    "validity_p95": "double", "wildcard_rate": "double", "punycode_rate": "double",
    "common_eku_sets": "array<string>", "current_day_count": "bigint", "trailing_daily_avg": "double",
}


def attach_baseline(certs: DataFrame, baselines: DataFrame | None) -> DataFrame:
    """Left join the per-issuer baseline; ``None`` = fast mode (no baseline)."""
    if baselines is None:
        out = certs
        for name, dtype in BASELINE_COLS.items():
            out = out.withColumn(name, F.lit(None).cast(dtype))
        return out.withColumn("has_baseline", F.lit(False))
    # One row per issuer. Spark broadcasts the side once its measured size is
    # below the session's threshold; beyond it, a large issuer's certificates
    # are split as a skewed join partition.
    b = baselines.select("issuer_key", *BASELINE_COLS.keys()).withColumn("has_baseline", F.lit(True))
    return (certs.join(b, "issuer_key", "left")
            .withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False))))


def score_certificates(certs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``signals`` (all, emission order), ``anomaly_score`` (capped sum)
    and ``top_signals`` (3 highest scores, ties by emission order)."""
    sigs = F.filter(signal_array(settings), lambda s: s.isNotNull())
    ranked = F.array_sort(F.col("signals"), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                          .when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0))
    out = with_signal_inputs(certs, settings).withColumn("signals", sigs)
    out = out.withColumn("anomaly_score", F.least(F.aggregate("signals", F.lit(0), lambda acc, s: acc + s["score"]),
                                                  F.lit(100)))
    out = out.withColumn("top_signals", F.slice(ranked, 1, 3))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _signal_json(s) -> Column:
    return F.concat(F.lit('{"code":"'), s["code"], F.lit('","evidence":'), s["evidence_json"],
                    F.lit(',"score":'), s["score"].cast("string"), F.lit(',"severity":"'), s["severity"],
                    F.lit('"}'))


def anomaly_finding(scored: DataFrame, created_at) -> DataFrame:
    """One ANOMALY_SCORE finding per certificate, even with score 0."""
    evidence = F.concat(F.lit('{"anomaly_score":'), F.col("anomaly_score").cast("string"),
                        F.lit(',"top_signals":['), F.array_join(F.transform("top_signals", _signal_json), ","),
                        F.lit("]}"))
    stamp = ts_lit(created_at) if created_at is not None else F.current_timestamp()
    return scored.select("cert_hash", F.lit("ANOMALY_SCORE").alias("finding_code"), F.lit("info").alias("severity"),
                         evidence.alias("evidence_json"), stamp.alias("created_at"))


def signal_rows(scored: DataFrame) -> DataFrame:
    """One row per emitted signal: (cert_hash, ordinal, code, severity, score, evidence_json)."""
    return scored.select("cert_hash", F.explode("signals").alias("s")).select("cert_hash", "s.*")
