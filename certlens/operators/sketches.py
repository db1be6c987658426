"""Mergeable sketches per (day, issuer): distinct counts (F5, G1-G3) and quantiles
(F1, G4) of any window without reading observations again.

* Theta sketches of certificates and registered domains, and of the certificates with a
  flag or an elevated score. They merge by union, and up to ``2 ** LG`` values they
  are exact; beyond, an estimate's relative standard error is ``2 ** -(LG / 2)``.
* KLL sketches of validity and SAN count, one value for each observation row (a
  certificate seen three times counts three times, as in the exact baselines). A
  quantile's rank is off by at most ``RANK_ERROR`` of the rows.

The exact reports stay the default. Bounds hold with a probability of about 99 in 100
and more; hashes are fixed, so a result never changes between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.functions.timewin import Span
from certlens.operators.rollups import FLAG_COUNTERS, _cert_flags

LG = 13
#: Three standard errors of a theta estimate.
COUNT_ERROR = 3 / 2 ** (LG / 2)
KLL_K = 400
#: Normalised rank error of a KLL sketch with this k, one-sided and single query, doubled.
RANK_ERROR = 0.014
ELEVATED_SCORE = 30
QUANTILE_COLUMNS = ["validity_days", "san_count"]
DISTINCTS = ["certs", "domains", "elevated"] + [flag for flag, _ in FLAG_COUNTERS]


def daily_sketches(observations: DataFrame, certificates: DataFrame, span: Span) -> DataFrame:
    """One row per (day, issuer_key) with a sketch for each of ``DISTINCTS`` and
    ``QUANTILE_COLUMNS``, and the number of observation rows.

    One grouping, combined map-side, of the observations joined to the latest
    certificates: what is shuffled by issuer is one row of sketches per task."""
    obs = span.filter(observations, "seen_at").select(F.to_date("seen_at").alias("day"), "issuer_key", "cert_hash", "registered_domain")
    facts = certificates.select("cert_hash", "anomaly_score", *QUANTILE_COLUMNS).join(_cert_flags(certificates), "cert_hash")
    rows = obs.join(facts, "cert_hash")
    cert = F.col("cert_hash")
    # a sketch takes no empty strings, and the empty domain is a value
    of = {"certs": cert, "domains": F.concat(F.lit("="), "registered_domain"), "elevated": F.when(F.col("anomaly_score") >= ELEVATED_SCORE, cert)}
    of |= {flag: F.when(F.col(flag) == 1, cert) for flag, _ in FLAG_COUNTERS}
    return rows.groupBy("day", "issuer_key").agg(
        F.count("*").alias("rows"), *[F.theta_sketch_agg(of[name], LG).alias(name) for name in DISTINCTS],
        *[F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), KLL_K).alias(c) for c in QUANTILE_COLUMNS])


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store sketches by day; only the days that they hold are replaced."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_sketches(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Stored sketches of a range of days (both ends included)."""
    rows = spark.read.parquet(path)
    if first_day is not None:
        rows = rows.filter(F.col("day") >= F.lit(first_day).cast("date"))
    return rows if last_day is None else rows.filter(F.col("day") <= F.lit(last_day).cast("date"))


def distinct_counts(sketches: DataFrame, by: list[str] = [], names: list[str] = DISTINCTS) -> DataFrame:  # noqa: B006 - not changed
    """Estimated distinct counts of the merged sketches, whole or ``by`` columns."""
    merged = sketches.groupBy(*by).agg(*[F.theta_union_agg(n, LG).alias(n) for n in names])
    return merged.select(*by, *[F.theta_sketch_estimate(n).cast("long").alias(n) for n in names])


def new_certificates(sketches: DataFrame, since_day: str) -> DataFrame:
    """(issuer_key, certs, new_certs): estimated certificates since a day, and those
    of them that no earlier stored day has (a set difference of sketches)."""
    recent = F.col("day") >= F.lit(since_day).cast("date")
    both = sketches.groupBy("issuer_key").agg(F.theta_union_agg(F.when(recent, F.col("certs")), LG).alias("now"),
                                              F.theta_union_agg(F.when(~recent, F.col("certs")), LG).alias("before"))
    return both.select("issuer_key", F.theta_sketch_estimate("now").cast("long").alias("certs"),
                       F.theta_sketch_estimate(F.theta_difference("now", "before")).cast("long").alias("new_certs"))


def quantiles(sketches: DataFrame, by: list[str], column: str, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, rank, value): quantiles of the merged sketches of a column."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint(column).alias("sketch"))
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias("value")) for r in ranks])
    return merged.select(*by, F.explode(pairs).alias("q")).select(*by, "q.rank", "q.value")


def count_in_bound(estimate: Column, exact: Column) -> Column:
    """Whether an estimate is exact where it must be, else within its error."""
    return F.when(exact <= 2 ** (LG - 1), estimate == exact).otherwise(F.abs(estimate - exact) <= F.lit(COUNT_ERROR) * exact)
