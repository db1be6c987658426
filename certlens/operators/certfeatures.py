"""Per-certificate name features shared by the lint rules and the signals.

Plan: the DNS names of the certificates are exploded once; every *distinct*
name is resolved once (registered domain via the suffix-rule join, IDNA
decode + confusable evidence for ``xn--`` names only, organisation tokens of
the registered domain); the exploded names join that table (and, if given,
the per-domain burst counts) and are regrouped per certificate. A regroup
holds at most the names of one certificate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.config import DEFAULT
from certlens.functions.hostnames import has_punycode, highest_label_entropy, suspicious_keywords
from certlens.functions.unicode import confusable_json, organization_tokens, to_unicode_hostname
from certlens.sources.psl import registered_domain_table

NAME_INFO = "name_info"
NAME_INFO_FIELDS = "pos", "name", "unicode_hostname", "confusable_json", "puny", "entropy", "keywords"


def host_table(names: DataFrame, rules: DataFrame, n_rules: int | None, host_col: str = "name",
               keywords: Sequence[str] = DEFAULT.thresholds.suspicious_keywords) -> DataFrame:
    """Distinct names -> (name, rd, unicode_hostname, confusable_json, rd_tokens,
    puny, entropy of the decoded form, keywords).

    One chain on the distinct names: suffix-rule aggregate, then the IDNA
    and token columns as projections (Python only sees ``xn--`` names and
    non-ASCII domains)."""
    rd = registered_domain_table(names, rules, host_col, n_rules).withColumnRenamed("registered_domain", "rd")
    decoded = rd.withColumn("unicode_hostname", to_unicode_hostname(F.col("host")))
    return decoded.select(
        F.col("host").alias("name"), "rd", "unicode_hostname",
        confusable_json(F.col("host"), F.col("unicode_hostname")).alias("confusable_json"),
        organization_tokens(F.col("rd")).alias("rd_tokens"), has_punycode(F.col("host")).alias("puny"),
        highest_label_entropy(F.when(has_punycode(F.col("host")), F.col("unicode_hostname")).otherwise(F.col("host"))).alias("entropy"),
        suspicious_keywords(F.col("host"), list(keywords)).alias("keywords"))


def name_features(certs: DataFrame, rules: DataFrame, n_rules: int | None = None,
                  bursts: DataFrame | None = None, burst_threshold: int = 5,
                  keywords: Sequence[str] = DEFAULT.thresholds.suspicious_keywords) -> DataFrame:
    """(cert_hash, registered_domains, domain_tokens, name_info, burst_matches).

    ``name_info`` is aligned with ``dns_names``: struct(pos, name,
    unicode_hostname, confusable_json). ``burst_matches`` lists (cert_count,
    registered_domain) of the certificate's domains with at least
    ``burst_threshold`` recent certificates, largest first.
    """
    exploded = certs.select("cert_hash", F.posexplode("dns_names").alias("pos", "name"))
    table = host_table(exploded, rules, n_rules, keywords=keywords)
    j = exploded.join(table, "name", "left")
    if bursts is not None:
        # Only domains at or above the threshold matter; Spark broadcasts the
        # table when its measured size allows, else joins by shuffle.
        hot = bursts.filter(F.col("cert_count") >= burst_threshold).select(
            F.col("registered_domain").alias("rd"), "cert_count")
        j = j.join(hot, "rd", "left")
    else:
        j = j.withColumn("cert_count", F.lit(None).cast("long"))
    per = j.groupBy("cert_hash").agg(
        F.array_sort(F.collect_list(F.struct(*NAME_INFO_FIELDS))).alias(NAME_INFO),
        F.array_distinct(F.collect_list(F.when(F.col("rd") != "", F.col("rd")))).alias("registered_domains"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.when(F.col("rd") != "", F.col("rd_tokens")).otherwise(F.array().cast("array<string>"))))))
        .alias("domain_tokens"),
        F.array_distinct(F.collect_list(F.when((F.col("rd") != "") & (F.col("cert_count") >= burst_threshold),
                                               F.struct(F.col("cert_count").cast("long").alias("cert_count"),
                                                        F.col("rd").alias("registered_domain")))))
        .alias("_bursts"))
    ordered = F.array_sort("_bursts", lambda a, b: F.when(a["cert_count"] > b["cert_count"], -1)
                           .when(a["cert_count"] < b["cert_count"], 1)
                           .when(a["registered_domain"] < b["registered_domain"], -1)
                           .when(a["registered_domain"] > b["registered_domain"], 1).otherwise(0))
    return per.withColumn("burst_matches", ordered).drop("_bursts")


def attach_name_features(certs: DataFrame, rules: DataFrame, n_rules: int | None = None,
                         bursts: DataFrame | None = None, burst_threshold: int = 5) -> DataFrame:
    """``certs`` plus the feature columns (certificates without names get empty ones)."""
    # A new scoring plan starts here: frames pinned for an earlier plan's
    # size checks are no longer needed (if still used, they recompute).
    feats = name_features(certs, rules, n_rules, bursts, burst_threshold)
    out = certs.join(feats, "cert_hash", "left")
    empty = F.array().cast("array<string>")
    return (out.withColumn("registered_domains", F.coalesce("registered_domains", empty))
            .withColumn("domain_tokens", F.coalesce("domain_tokens", empty))
            .withColumn("burst_matches", F.coalesce("burst_matches", F.array().cast(
                "array<struct<cert_count:bigint,registered_domain:string>>")))
            .withColumn(NAME_INFO, F.coalesce(NAME_INFO, F.array().cast(
                "array<struct<pos:int,name:string,unicode_hostname:string,confusable_json:string,puny:boolean,entropy:double,keywords:array<string>>>"))))
