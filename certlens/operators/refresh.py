"""Incremental refresh of the stored rollups (F7): only the days that changed since
the last refresh are computed and replaced.

* ``touched_days`` has one small folder for each ingest batch: the days it added rows to.
* A refresh takes the batches beyond the last one in its log, reads only these days
  (partition pruning), and replaces only these day folders of each rollup (dynamic
  partition overwrite). Counts depend on the latest certificate versions too, so days on
  which a certificate with new attributes was seen are taken as well (``restated_days``).
* The log row is written last. A run that stops before it leaves days that the next run
  computes and replaces again, so running twice gives the same tables as running once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.functions.timewin import Span, date_lit, ts_lit
from certlens.operators.latest import latest_versions
from certlens.operators.rollups import _cert_flags, daily_issuer_stats, daily_sigalg_stats
from certlens.operators.sketches import QUANTILE_COLUMNS, daily_sketches

TOUCHED = "touched_days"
LOG = "refresh_log"
TOUCHED_SCHEMA = "day date, rows long, batch_id int"
LOG_SCHEMA = "up_to_batch int, days int, refreshed_at timestamp"


def _has_rows(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def record_touched(batch: DataFrame, root: str, batch_id: int, time_col: str = "seen_at") -> None:
    """Note the days of a batch's observations, and a row without a day, so that a batch
    without observations is known too; a replayed batch writes the same again."""
    days = batch.groupBy(F.to_date(time_col).alias("day")).agg(F.count("*").alias("rows"))
    mark = batch.sparkSession.range(1).select(F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("rows"))
    days.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{root}/{TOUCHED}/batch_id={batch_id}")


def pending_days(spark: SparkSession, root: str, span: Span) -> tuple[list[date], int, int]:
    """Days in ``span`` touched by batches after the last refresh, oldest first (at most
    the days of the window), the last refreshed batch and the newest one."""
    since = -1
    if _has_rows(spark, f"{root}/{LOG}"):
        since = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/{LOG}").agg(F.max("up_to_batch")).first()[0]
    if not _has_rows(spark, f"{root}/{TOUCHED}"):
        return [], since, since
    fresh = spark.read.schema(TOUCHED_SCHEMA).parquet(f"{root}/{TOUCHED}").filter(F.col("batch_id") > since)
    newest = fresh.agg(F.max("batch_id")).first()[0]
    inside = fresh.filter(F.col("day") >= date_lit(span.start))
    return [r.day for r in inside.select("day").distinct().orderBy("day").collect()], since, since if newest is None else newest


def changed_certificates(versions: DataFrame, since_batch: int) -> DataFrame:
    """cert_hash of the certificates known before whose counted attributes are different
    in their latest version after batch ``since_batch`` (``versions`` has a batch_id)."""
    facts = lambda v, name: _cert_flags(v).join(v.select("cert_hash", "sig_alg", "anomaly_score", *QUANTILE_COLUMNS), "cert_hash").select(
        "cert_hash", F.struct(*[c for c in _cert_flags(v).columns if c != "cert_hash"], "sig_alg", "anomaly_score", *QUANTILE_COLUMNS).alias(name))
    new = versions.filter(F.col("batch_id") > since_batch).select("cert_hash").distinct()
    mine = versions.join(new, "cert_hash", "left_semi")
    before = latest_versions(mine.filter(F.col("batch_id") <= since_batch))
    return (facts(before, "old").join(facts(latest_versions(mine), "new"), "cert_hash")
            .filter(~F.col("old").eqNullSafe(F.col("new"))).select("cert_hash"))


def restated_days(observations: DataFrame, changed: DataFrame, span: Span) -> list[date]:
    """Days in ``span`` on which a changed certificate was seen (at most the window's)."""
    seen = span.filter(observations, "seen_at").select(F.to_date("seen_at").alias("day"), "cert_hash")
    return [r.day for r in seen.join(changed, "cert_hash", "left_semi").select("day").distinct().collect()]


def replace_days(rows: DataFrame, path: str) -> None:
    """Write rollup rows by day; folders of other days stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def refresh_days(observations: DataFrame, certificates: DataFrame, root: str, days: list[date], as_of) -> None:
    """Compute the rollups of whole days (sorted) and replace them."""
    span = Span.dates(days[0], days[-1])
    of_days = F.to_date("seen_at").isin([d.isoformat() for d in days])
    if "seen_day" in observations.columns:
        of_days = F.col("seen_day").isin(days)
    obs = observations.filter(of_days)
    replace_days(daily_issuer_stats(obs, certificates, span, as_of), f"{root}/issuer_daily_stats")
    replace_days(daily_sigalg_stats(obs, certificates, span, as_of), f"{root}/issuer_sigalg_stats")
    replace_days(daily_sketches(obs, certificates, span), f"{root}/issuer_sketches")


def refresh_touched(observations: DataFrame, certificates: DataFrame, root: str, as_of, span: Span, versions: DataFrame | None = None) -> list[date]:
    """bring the rollups below ``root`` up to date; returns the days replaced.

    With ``versions`` (all certificate versions with their batch_id) days are restated
    whose certificates have changed. Nothing new: nothing is read but the small tables."""
    spark = observations.sparkSession
    days, since, newest = pending_days(spark, root, span)
    if newest == since:
        return []
    if versions is not None and since >= 0:
        days = sorted({*days, *restated_days(observations, changed_certificates(versions, since), span)})
    if days:
        refresh_days(observations, certificates, root, days, as_of)
    row = spark.range(1).select(F.lit(newest).cast("int").alias("up_to_batch"), F.lit(len(days)).cast("int").alias("days"), ts_lit(as_of).cast("timestamp").alias("refreshed_at"))
    row.write.mode("append").parquet(f"{root}/{LOG}")
    return days
