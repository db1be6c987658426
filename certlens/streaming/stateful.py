"""Stateful streams: sliding burst windows with keyed state and timers (L4), and
exact daily distinct counts in one streaming plan (L2, L3).

Nothing that a batch has read is read again: what later windows need is in the state
store (RocksDB), which lies with the checkpoint below ``spark.checkpoint.dir`` and
survives a lost executor. Results go to a Parquet sink, each once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from certlens.session import shared_path
from certlens.streaming.jobs import file_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
#: Hash buckets of the certificates of one domain: a domain with a third of all
#: sightings is spread over so many states and tasks.
BUCKETS = 4


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider; it also holds more than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass
class StreamResult:
    """Where a finished stream wrote its rows, and its counts."""

    path: str
    late_rows: int
    state_rows: int


def run_to_parquet(stream: DataFrame, name: str, late_operator: str | None = None) -> StreamResult:
    """Process what is there, append the results to a Parquet sink and stop.

    ``late_rows`` counts the rows that the operator of that name (all, if none is
    named) dropped because the watermark had passed them."""
    spark = stream.sparkSession
    root = shared_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    late = state = 0
    for progress in query.recentProgress:
        for op in progress["stateOperators"]:
            if late_operator is None or op["operatorName"] == late_operator:
                late += op["numRowsDroppedByWatermark"]
            state = max(state, op["numRowsTotal"])
    return StreamResult(f"{root}/rows", late, state)


def result_rows(spark: SparkSession, result: StreamResult, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(result.path)


def _above_watermark(condition: Column) -> Column:
    """A filter that is not pushed below the watermark, because it names the time in a
    disjunction that can't be split: the rows that it drops still move the watermark."""
    return condition | (F.col("seen_at") < F.lit("0001-01-01").cast("timestamp"))


# ---- L4: sliding burst windows -----------------------------------------------

BURST_ROWS = "registered_domain string, bucket int, window_end timestamp, cert_count long"


class BurstWindows(StatefulProcessor):
    """Distinct certificates of one (domain, bucket) in every sliding window.

    State: ``seen`` lists certificates with the last hour in which each was seen, as far
    as windows still open can contain it; ``pending`` holds (hour, certificate) pairs
    that the watermark has not passed. One timer is set, at the end of the first window
    that has not been reported. When it fires, all windows up to the watermark are
    reported, certificates that no later window contains are evicted, and the timer is
    set anew as long as any state is left. Both lists are read and replaced whole, as
    one call a certificate takes longer than all else."""

    def __init__(self, window_hours: int):
        self.hours = window_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "hour long, cert_hash string")
        self.pending = handle.getListState("pending", "hour long, cert_hash string")
        self.due = handle.getValueState("due", "hour long")

    def _set_timer(self, hour: int) -> None:
        self.due.update((hour,))
        self.handle.registerTimer(hour * HOUR_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pairs = pd.concat([r[["hour", "cert_hash"]] for r in rows]).drop_duplicates()
        self.pending.appendList(list(pairs.itertuples(index=False, name=None)))
        first = int(pairs["hour"].min()) + 1
        due = self.due.get() if self.due.exists() else None
        if due is None or first < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0] * HOUR_MS)
            self._set_timer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0]
        done = timerValues.getCurrentWatermarkInMs() // HOUR_MS  # the last window end that has passed
        sightings = [(cert, hour) for hour, cert in (self.seen.get() if self.seen.exists() else ())]
        later = []
        for hour, cert in (self.pending.get() if self.pending.exists() else ()):
            if hour < done:
                sightings.append((cert, hour))
            else:
                later.append((hour, cert))
        kept = []
        if sightings:
            frame = pd.DataFrame(sightings, columns=["cert", "hour"]).sort_values(["cert", "hour"], ignore_index=True)
            cert, hour = frame["cert"].to_numpy(), frame["hour"].to_numpy()
            last = np.append(cert[1:] != cert[:-1], True)
            # a sighting counts in the windows that end 1 to ``hours`` hours later, or until its certificate is seen again
            until = np.where(last, hour + self.hours, np.minimum(hour + self.hours, np.append(hour[1:], 0)))
            change = np.zeros(done - due + 2, np.int64)
            np.add.at(change, np.clip(hour + 1 - due, 0, done - due + 1), 1)
            np.add.at(change, np.clip(until + 1 - due, 0, done - due + 1), -1)
            counts = np.cumsum(change)[:-1]
            ends = np.flatnonzero(counts)
            if len(ends):
                yield pd.DataFrame({"registered_domain": key[0], "bucket": key[1], "window_end": pd.to_datetime((ends + due) * HOUR_MS, unit="ms"), "cert_count": counts[ends]})
            open_ = last & (until > done)
            kept = list(zip(hour[open_].tolist(), cert[open_].tolist()))
        if later:
            self.pending.put(later)
        else:
            self.pending.clear()
        if kept:
            self.seen.put(kept)
            self._set_timer(int(done) + 1)
        elif later:
            self._set_timer(min(h for h, _ in later) + 1)
        else:
            self.due.clear()
        if not kept:
            self.seen.clear()

    def close(self) -> None:
        pass


def burst_stream(observations: DataFrame, window_hours: int = 12, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(registered_domain, bucket, window_end, cert_count): distinct certificates of
    each non-empty domain, by bucket, in the windows of ``window_hours`` that
    step by an hour. A window is reported once the watermark has passed its end; later rows
    of it are dropped. Rows without a domain only move the watermark."""
    use_state_store(observations.sparkSession)
    rows = (observations.withWatermark("seen_at", delay)
            .filter(_above_watermark(F.col("registered_domain") != ""))
            .withColumn("hour", F.floor(F.unix_millis("seen_at") / HOUR_MS))
            .withColumn("bucket", F.pmod(F.xxhash64("cert_hash"), F.lit(buckets)).cast("int"))
            .select("seen_at", "registered_domain", "bucket", "hour", "cert_hash"))
    return rows.groupBy("registered_domain", "bucket").transformWithStateInPandas(
        BurstWindows(window_hours), outputStructType=BURST_ROWS, outputMode="Append", timeMode="EventTime")


def sliding_burst_counts(spark: SparkSession, source_dir: str, window_hours: int = 12, max_files: int | None = 4, delay: str = "1 hour") -> DataFrame:
    """L4: distinct certificates per registered domain in every closed sliding window
    of ``window_hours`` (step one hour), from a stream over a landing folder. The
    buckets' counts, whose certificates are disjoint, are added up."""
    result = run_to_parquet(burst_stream(file_stream(spark, source_dir, max_files), window_hours, delay), "burst")
    counts = result_rows(spark, result, BURST_ROWS).groupBy("window_end", "registered_domain").agg(F.sum("cert_count").cast("long").alias("cert_count"))
    end = F.col("window_end").cast("timestamp_ntz")
    return counts.select((end - F.expr(f"INTERVAL {window_hours} HOURS")).alias("window_start"), end.alias("window_end"), "registered_domain", "cert_count")


# ---- L2, L3: exact daily distincts in one streaming plan ----------------------

DAILY_ROWS = "window struct<start:timestamp,end:timestamp>, issuer_key string, cert_count long, domain_count long, observations long"
DEDUPE = "dedupeWithinWatermark"


def daily_stream(observations: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per (day, issuer): exact distinct certificates and domains, and observation
    rows, as one append stream: ``dropDuplicatesWithinWatermark`` lets each certificate
    and domain of a day and issuer through once and feeds a windowed sum. A day is
    reported when the watermark passes its end; rows later than that are dropped.

    ``delay`` must be a day at least: a value's state is kept until the watermark is
    that far beyond its first sighting, so it outlasts the day."""
    rows = (observations.withWatermark("seen_at", delay).filter(_above_watermark(F.col("issuer_key").isNotNull()))
            .select("seen_at", "issuer_key", "cert_hash", "registered_domain", F.date_trunc("day", "seen_at").alias("day")))
    of = F.explode(F.array(F.struct(F.lit("cert").alias("kind"), F.col("cert_hash").alias("value")), F.struct(F.lit("domain").alias("kind"), F.col("registered_domain").alias("value"))))
    values = rows.withColumn("of", of).select("seen_at", "issuer_key", "day", "of.kind", "of.value")
    first = values.dropDuplicatesWithinWatermark(["day", "issuer_key", "kind", "value"]).select("seen_at", "issuer_key", "kind")
    every = rows.select("seen_at", "issuer_key", F.lit("row").alias("kind"))
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    return first.union(every).groupBy(F.window("seen_at", "1 day"), "issuer_key").agg(
        count("cert").alias("cert_count"), count("domain").alias("domain_count"), count("row").alias("observations"))


def tumbling_daily(spark: SparkSession, source_dir: str, max_files: int | None = 4, delay: str = "1 day") -> tuple[DataFrame, int]:
    """L3: closed days of ``daily_stream`` over a landing folder, and how many late
    observations were dropped (each is two values at the deduplication)."""
    result = run_to_parquet(daily_stream(file_stream(spark, source_dir, max_files), delay), "daily", DEDUPE)
    rows = result_rows(spark, result, DAILY_ROWS)
    start, end = F.col("window.start").cast("timestamp_ntz"), F.col("window.end").cast("timestamp_ntz")
    return rows.select(start.alias("window_start"), end.alias("window_end"), "issuer_key", "cert_count", "domain_count", "observations"), result.late_rows // 2
