"""Exact duplicates with a heavy-hitter split. DataFrame functions only.

Texts are equal when they agree after deleting white space; a text stands for
itself by the SHA-256 of what is left (32 bytes). Of equal texts the row with
the most code points stays, then the smallest doc_id (null last), then the
smallest hash of the whole text, then one of the rows that agree in all that.

1. Frequent digests: a Misra-Gries summary (Spark's frequent-items sketch: at most
   ``COUNTERS`` counters, lowered together when they run out) for every task, merged
   in ``LANES`` lanes and then once. Whatever holds more than about ``3.5 / COUNTERS``
   of all rows is among its candidates.
2. Verified winners: one pass counts the candidates exactly and finds the row that
   stays. Digests with at least ``1 / WINNERS`` of all rows are winners, so there are
   at most ``WINNERS`` of them whatever the data.
3. Rows of winners meet the broadcast winners where they are and are not shuffled;
   the others are grouped and joined by digest in an ordinary shuffle, in which
   no digest has a larger share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import free_name, keep, row_key, side

COUNTERS = 8192
LANES = 64
WINNERS = 1024
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _slim(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """What the decisions need of each row, written once."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), F.length(body).alias("chars"),
                       F.xxhash64(body).alias("tie"), row_key(doc_id, text).alias("key"), F.monotonically_increasing_id().alias("row"))
    return keep(rows, "copies-rows")


def _best() -> Column:
    """The row of a group that stays."""
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie"), F.col("row"), F.col("key"))
    return F.min(order).alias("best")


def frequent_digests(slim: DataFrame) -> DataFrame:
    """(digest, size, best): the digests with at least ``1 / WINNERS`` of all rows,
    counted exactly; an empty table if there are none."""
    rows = slim.count()
    hashed = slim.withColumn("h", F.xxhash64("digest"))
    lanes = hashed.withColumn("lane", F.spark_partition_id() % LANES).groupBy("lane").agg(F.expr(f"approx_top_k_accumulate(h, {COUNTERS})").alias("summary"))
    # grouped, so that tasks without a summary send none
    found = lanes.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {COUNTERS}), {min(WINNERS, COUNTERS)})").alias("top"))
    candidates = found.select(F.explode("top.item").alias("h")) if rows else hashed.select("h")  # no rows, no summary
    counted = hashed.join(F.broadcast(candidates), "h", "left_semi").groupBy("digest").agg(F.count("*").alias("size"), _best())
    return keep(counted.filter((F.col("size") > 1) & (F.col("size") * WINNERS >= rows)), "copies-winners")


def _decide(slim: DataFrame, winners: DataFrame) -> DataFrame:
    frequent = slim.join(F.broadcast(winners), "digest")
    rare = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rare.groupBy("digest").agg(F.count("*").alias("size"), _best())
    return frequent.unionByName(rare.join(groups, "digest"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Null texts, empty ones and those of white space only are equal. Of rows that
    agree in doc_id and text one is kept. A null doc_id loses every tie. Columns
    beyond the two named are not looked at; texts of any length stay in the JVM;
    an empty table gives an empty result."""
    slim = _slim(docs, text, doc_id)
    return _decide(slim, frequent_digests(slim)).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see
    ``exact_groups``). Copies of frequent texts are removed where they are read;
    of the others, the rows to remove are joined by a fingerprint of doc_id and text."""
    slim = _slim(docs, text, doc_id)
    winners = frequent_digests(slim)
    decided = keep(_decide(slim, winners).filter("size > 1").groupBy("key").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("row") == F.col("best.row"), 1)).alias("kept"), F.first("digest").alias("digest")), "copies-keys")
    d, k, w = (free_name(docs, x) for x in ("digest", "row_key", "winner"))
    every = docs.withColumn(d, digest(F.col(text))).withColumn(k, row_key(doc_id, text))
    best = winners.select(F.col("digest").alias(d), F.col("best.key").alias(w))
    left = every.join(F.broadcast(best), d, "left").filter(F.col(w).isNull() | (F.col(w) == F.col(k)))
    rare = decided.join(F.broadcast(winners), "digest", "left_anti")
    left = left.join(side(rare.filter("kept = 0").select(F.col("key").alias(k))), k, "left_anti")
    twice = side(decided.filter("kept = 1 AND rows > 1").select(F.col("key").alias(k)))
    one = left.join(twice, k, "left_semi").dropDuplicates([k])
    return left.join(twice, k, "left_anti").unionByName(one).select(*docs.columns)
