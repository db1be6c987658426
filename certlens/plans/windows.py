"""All dashboard windows in one pass (G9): the window is a grouping key.

A row that falls into the last 7 days also falls into the last 30, 90 and 365. So each
row is counted once, under the smallest window that holds it (for distinct certificates:
of each value and certificate, the newest sighting's), and only these few counts are
expanded to the larger windows and added up. Each table is scanned once for all windows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlens.functions.timewin import Span, as_datetime, ts_lit
from certlens.plans import reports as G


def smallest_window(time: str, as_of, windows: list[int]) -> Column:
    """The smallest window (days) that holds a time; null if none does."""
    out = None
    for days in sorted(windows):
        start = ts_lit(as_datetime(as_of) - timedelta(days=days))
        out = F.when(F.col(time) >= start, days) if out is None else out.when(F.col(time) >= start, days)
    return out


def each_window(window: Column, windows: list[int]) -> Column:
    """One row for every window that holds what the smallest one holds."""
    return F.explode(F.filter(F.array(*[F.lit(w) for w in sorted(windows)]), lambda w: w >= window))


def _pairs(of: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(name).alias("group_by"), col.alias("value")) for name, col in of.items()]))


def window_breakdowns(observations: DataFrame, certificates: DataFrame, findings: DataFrame, as_of, windows: list[int], cert_dims: list[str], limit: int = 12) -> DataFrame:
    """(days, group_by, value, count, rank): the breakdowns by certificate
    dimensions, finding code, severity and registered domain of every window, the same
    as ``reports.breakdown`` gives for each alone."""
    widest = Span.trailing(as_of, max(windows))
    certs = (certificates.filter(widest.contains("last_seen")).withColumn("w", smallest_window("last_seen", as_of, windows))
             .select("w", _pairs({d: G.cert_dimension(d) for d in cert_dims}).alias("p")).groupBy("p.group_by", "p.value", "w").agg(F.count("*").alias("n")))
    found = (widest.filter(findings, "created_at", "created_day").withColumn("w", smallest_window("created_at", as_of, windows))
             .select("w", "cert_hash", _pairs({"finding_code": F.col("finding_code"), "severity": F.col("severity")}).alias("p")).filter(F.col("p.value") != ""))
    seen = (widest.filter(observations, "seen_at").select(smallest_window("seen_at", as_of, windows).alias("w"), "cert_hash",
                                                          F.struct(F.lit("registered_domain").alias("group_by"), F.col("registered_domain").alias("value")).alias("p")))
    distinct = found.unionByName(seen).groupBy("p.group_by", "p.value", "cert_hash").agg(F.min("w").alias("w"))
    counts = certs.unionByName(distinct.groupBy("group_by", "value", "w").agg(F.count("*").alias("n")))
    of_windows = counts.select(each_window(F.col("w"), windows).alias("days"), "group_by", "value", "n")
    totals = of_windows.groupBy("days", "group_by", "value").agg(F.sum("n").cast("long").alias("count"))
    order = Window.partitionBy("days", "group_by").orderBy(F.desc("count"), F.asc("value"))
    return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def window_profiles(certificates: DataFrame, as_of, windows: list[int]) -> DataFrame:
    """The issuer profile (G4) of every window, one row each: (days, cert_count,
    percentiles, rates). Equal (validity, SAN count, flags) are counted first, so what
    is expanded to the windows is small."""
    flags = [flag for flag, _ in G.PROFILE_RATES]
    columns = ["validity_days", "san_count", *flags]
    rows = (certificates.filter(Span.trailing(as_of, max(windows)).contains("last_seen")).withColumn("w", smallest_window("last_seen", as_of, windows))
            .groupBy("w", *columns).agg(F.count("*").alias("n")))
    each = rows.select(each_window(F.col("w"), windows).alias("days"), *columns, "n")
    n = F.col("n")
    quantile = lambda c, p: F.percentile(F.col(c), p, n)
    return each.groupBy("days").agg(
        F.sum(n).cast("long").alias("cert_count"), quantile("validity_days", 0.5).alias("validity_p50"), quantile("validity_days", 0.95).alias("validity_p95"),
        quantile("san_count", 0.5).alias("san_count_p50"), quantile("san_count", 0.95).alias("san_count_p95"),
        *[(F.sum(F.col(flag) * n) / F.sum(F.when(F.col(flag).isNotNull(), n))).alias(name) for flag, name in G.PROFILE_RATES])
