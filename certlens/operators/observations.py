"""Observation fan-out (A11): one row per distinct registered domain of a
certificate event, with the sorted union of the label-suffix tokens of the
names in that domain; an event without any domain keeps one row with
``registered_domain = ''`` and no tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.functions.hostnames import tokenize_domain
from certlens.sources.psl import registered_domain_table

EVENT_COLS = ["seen_at", "cert_hash", "issuer_key", "log_id"]


def observation_fanout(events: DataFrame, rules: DataFrame, n_rules: int | None = None,
                       key: str = "event_id", source: str = "certstream") -> DataFrame:
    """``events``: (key, seen_at, cert_hash, issuer_key, log_id, dns_names).

    Names are exploded and resolved against the distinct-host suffix table;
    the per-event regrouping collects at most the names of one certificate.
    """
    names = events.select(key, *EVENT_COLS, F.explode_outer("dns_names").alias("name"))
    # Registered domain and suffix tokens are computed once per distinct name.
    table = (registered_domain_table(names, rules, "name", n_rules)
             .select(F.col("host").alias("name"), F.col("registered_domain").alias("rd"),
                     tokenize_domain("host").alias("tokens")))
    resolved = names.join(table, "name", "left")
    item = F.struct(F.coalesce("rd", F.lit("")).alias("rd"),
                    F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    per_event = resolved.groupBy(key, *EVENT_COLS).agg(F.collect_list(item).alias("items"))
    named = F.filter("items", lambda x: x["rd"] != "")
    domains = F.array_sort(F.array_distinct(F.transform(named, lambda x: x["rd"])))
    grouped = F.transform(domains, lambda d: F.struct(
        d.alias("registered_domain"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(named, lambda x: x["rd"] == d),
                                                            lambda x: x["tokens"])))).alias("domain_tokens")))
    empty = F.array(F.struct(F.lit("").alias("registered_domain"),
                             F.array().cast("array<string>").alias("domain_tokens")))
    rows = per_event.select(key, *EVENT_COLS,
                            F.explode(F.when(F.size(domains) == 0, empty).otherwise(grouped)).alias("o"))
    return rows.select("seen_at", "cert_hash", F.col("o.registered_domain").alias("registered_domain"),
                       "issuer_key", "log_id", F.lit(source).alias("source"),
                       F.col("o.domain_tokens").alias("domain_tokens"))
