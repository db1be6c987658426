"""Certificate-stream message envelope.

Messages are JSON text (one per row, e.g. the value column of a Kafka
source or lines of JSON files). Only ``certificate_update`` messages pass;
the leaf DER is the first non-empty of ``as_der``/``der``/``cert``
(base64), chain items likewise; ``seen`` epoch seconds become the event
time (else the processing time); the log id is the source name, else its
URL, else 'certstream'. Messages without a leaf are dropped; undecodable
base64 goes to the quarantine side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DER = T.StructType([T.StructField(k, T.StringType()) for k in ("as_der", "der", "cert")])
MESSAGE_SCHEMA = T.StructType([
    T.StructField("message_type", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("leaf_cert", _DER),
        T.StructField("chain", T.ArrayType(_DER)),
        T.StructField("seen", T.DoubleType()),
        T.StructField("source", T.StructType([T.StructField("name", T.StringType()),
                                              T.StructField("url", T.StringType())])),
    ])),
])


def _first_der(item: Column) -> Column:
    pick = lambda k: F.when(item[k] != "", item[k])
    return F.coalesce(pick("as_der"), pick("der"), pick("cert"))


def _b64(text: Column) -> Column:
    """Decoded bytes, NULL when the text is not valid base64."""
    clean = F.regexp_replace(text, r"\s", "")
    return F.when(clean.rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.unbase64(clean))


def parse_messages(raw: DataFrame, value_col: str = "value", counters: Observation | None = None) -> DataFrame:
    """-> (message columns) + leaf_der, chain_der, seen_at, log_id, cert_hash, error.

    ``counters`` observes the certificate updates as they pass: received_events, those
    without a leaf (no_leaf), and those that are not valid base64 (undecodable)."""
    m = F.from_json(F.col(value_col), MESSAGE_SCHEMA)
    df = raw.select("*", m.alias("m")).filter(F.col("m.message_type") == "certificate_update")
    leaf_text = _first_der(F.col("m.data.leaf_cert"))
    chain = F.filter(F.transform(F.coalesce(F.col("m.data.chain"), F.array()), _first_der), lambda x: x.isNotNull())
    seen = F.col("m.data.seen")
    src = F.col("m.data.source")
    out = df.select(
        "*",
        leaf_text.alias("leaf_b64"),
        _b64(leaf_text).alias("leaf_der"),
        F.transform(chain, _b64).alias("chain_der"),
        F.coalesce(F.timestamp_seconds(seen), F.current_timestamp()).alias("seen_at"),
        F.coalesce(F.when(src["name"] != "", src["name"]), F.when(src["url"] != "", src["url"]),
                   F.lit("certstream")).alias("log_id"),
    ).withColumn("error", F.when(F.col("leaf_der").isNull(), F.lit("invalid base64 leaf")).when(
        F.exists("chain_der", lambda x: x.isNull()), F.lit("invalid base64 chain")))
    if counters is not None:
        leaf = F.col("leaf_b64").isNotNull()
        out = out.observe(counters, F.count(F.lit(1)).alias("received_events"), F.count(F.when(~leaf, 1)).alias("no_leaf"),
                          F.count(F.when(leaf & F.col("error").isNotNull(), 1)).alias("undecodable"))
    return out.filter(F.col("leaf_b64").isNotNull()).withColumn("cert_hash", F.sha2("leaf_der", 256)).drop("m")


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) by the ``error`` column."""
    return parsed.filter(F.col("error").isNull()), parsed.filter(F.col("error").isNotNull())
