"""Mixing sources to target weights: capped water-filling, then seeded whole and
fractional repetitions. DataFrame functions only.

Targets: every source gets its weight's share of the total, but no more than
``MAX_EPOCHS`` times its size; the excess goes to the others by weight. That is a
water level: a source's target is ``min(cap, level * weight)``. The level rises
until no source is above its cap; each round is one aggregation over the sources.

Repetitions: a source whose target is ``k + f`` times its size takes every
document ``k`` times and a seeded random fraction ``f`` of the words once more.
Documents stand in the order of a seeded hash; those that end before the
fraction's last word are taken once more as a whole, the one that holds it in
part, so a source's taken words are its target, rounded. The order is cut into
buckets of about ``BUCKET`` documents by hash range, so no source is sorted in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlens.llm.shared import free_name, keep

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
BUCKET = 4096
SEED = 20240131


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n) -> the same plus weight and target (double).

    Weights repeat over the sources in code point order, null last. Sources of
    size 0 get target 0. An empty table gives an empty result."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = keep(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double")), "mix-sources")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        held, weight = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        new = (total - held) / weight
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _placed(rows: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, sizes: DataFrame) -> DataFrame:
    """rows (source, size, place, ...) with source_size, target, whole, extra."""
    targets = source_targets(sizes, weights, share, max_epochs)
    parts = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).alias("buckets"),
    ).withColumn("more", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long"))
    # the hash's first digits, cut into equal ranges
    share_of = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(parts, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.least(F.floor(share_of * F.col("buckets")), F.col("buckets") - 1))

    held = bucketed(rows.select("source", "size", "place")).groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = held.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (
        F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed(rows).withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    left = F.col("more") - F.col("ahead") - F.coalesce("before", F.lit(0))
    return placed.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))


def _slim(docs: DataFrame, text: str, source: str, doc_id: str, seed: int, *more: Column) -> DataFrame:
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id).cast("string"), F.md5(F.col(text))))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("place"), *more)


def _sizes(slim: DataFrame) -> DataFrame:
    return slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3),
        share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, extra, taken) for every
    row of ``docs``: it is taken ``whole`` times as a whole and ``extra`` words of
    it once more.

    Null and empty texts have size 0 and are never taken. A null source is a
    source. Rows that agree in doc_id and text are interchangeable, so reruns
    return the same rows; columns beyond the three named are not looked at. An
    empty table gives an empty result."""
    slim = keep(_slim(docs, text, source, doc_id, seed), "mix-rows")
    taken = (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    return _placed(slim, weights, share, max_epochs, _sizes(slim)).select("doc_id", "source", "size", "source_size", "target", "whole", "extra", taken)


def mixture(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", length: str | None = None, weights: tuple[int, ...] = (1, 2, 3),
            share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as ``mix`` takes
    it, with all its columns and repetition (from 1) and taken (words). A row that
    is taken in part has the first words of its text, joined by spaces, and its
    number of code points in ``length`` (an existing column), if named."""
    sizes = keep(_sizes(_slim(docs, text, source, doc_id, seed)), "mix-sizes")
    rows = _slim(docs, text, source, doc_id, seed, F.struct(*docs.columns).alias("row"))
    placed = _placed(rows, weights, share, max_epochs, sizes)
    times = F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)
    each = placed.filter((F.col("size") > 0) & (times > 0)).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.when(F.col("repetition") > F.col("whole"), F.col("extra")).otherwise(F.col("size"))
    each = each.withColumn("taken", words)
    part = F.col("taken") < F.col("size")
    body = F.col("row")[text]
    cut = F.when(part, F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")).otherwise(body)
    out = each.withColumn("body", cut)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("body").alias(c))
        elif c == length:
            columns.append(F.when(part, F.length("body").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return out.select(*columns, *(F.col(c).alias(free_name(docs, c)) for c in ("repetition", "taken")))
