"""Stored tables: the engine's base tables written once, read by every report.

Reports in the original run against stored tables (certificates, observations,
findings). Here an ingest step derives them from the driver tables and
writes them as Parquet under the shared folder named by
``spark.checkpoint.dir``: observations partitioned by ``seen_day`` (so
trailing windows prune whole days), certificate versions, the compacted
latest certificates and the findings. findings partitioned by
``created_day``; latest certificates in ranges of ``cert_hash``.
Later reads get partition pruning,
predicate pushdown and column pruning from the Parquet scan.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from certlens.operators.latest import latest_versions
from certlens.session import shared_path, ship_package

#: Options for tables that are looked up by cert_hash but not sorted by it: a Bloom filter
#: in each row group's footer. The column's values hardly repeat inside a row group, so
#: they get no dictionary (a column with one gets no filter).
BLOOM_CERT = {"parquet.bloom.filter.enabled#cert_hash": "true", "parquet.enable.dictionary#cert_hash": "false"}

_LOCK = threading.Lock()
_DONE: dict[tuple[str, str], str] = {}
_SCHEMAS: dict[str, StructType] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, os.path.realpath(sf_dir)


def write_tables(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Ingest: derive and write the base tables (one job per table)."""
    from certlens.sources import adapters as A

    obs = A.derive_observations(spark, sf_dir).withColumn("seen_day", F.to_date("seen_at"))
    # Rebalanced by day: small days share a task, a large day is split by its
    # size into several tasks and files. Inside files: sorted like the original sort key (domain, time, cert) so
    # the Parquet min/max statistics let domain filters skip row groups.
    (obs.hint("rebalance", F.col("seen_day")).sortWithinPartitions("seen_day", "registered_domain", "seen_at", "cert_hash")
     .write.options(**BLOOM_CERT).mode("overwrite").partitionBy("seen_day").parquet(f"{root}/observations"))
    versions = A.derive_certificate_versions(spark, sf_dir, full_schema=True)
    versions.write.options(**BLOOM_CERT).mode("overwrite").parquet(f"{root}/certificate_versions")
    stored_versions = spark.read.parquet(f"{root}/certificate_versions")
    # Ranges of cert_hash, sorted: a look-up by cert_hash reads one row group.
    (latest_versions(stored_versions).repartitionByRange("cert_hash").sortWithinPartitions("cert_hash")
     .write.mode("overwrite").parquet(f"{root}/certificates"))
    findings = A.derive_cert_findings(spark, sf_dir).withColumn("created_day", F.to_date("created_at"))
    (findings.hint("rebalance", F.col("created_day"))
     .sortWithinPartitions("created_day", "cert_hash", "finding_code", "created_at")
     .write.mode("overwrite").partitionBy("created_day").parquet(f"{root}/cert_findings"))


def ensure_tables(spark: SparkSession, sf_dir: str) -> str:
    """Root folder of the stored tables for ``sf_dir`` (written on first use)."""
    key = _key(spark, sf_dir)
    ship_package(spark)
    with _LOCK:
        if key not in _DONE:
            tag = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
            root = shared_path(spark, f"tables-{tag}")
            write_tables(spark, sf_dir, root)
            _DONE[key] = root
        return _DONE[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its schema is looked up in the files once, so that later
    reads run no job."""
    path = f"{ensure_tables(spark, sf_dir)}/{name}"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


#: Buckets of the co-located tables; about one per 256 MB of observations.
BUCKETS = 8


def bucketed(spark: SparkSession, sf_dir: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Observations and latest certificates bucketed and sorted by cert_hash (E1), written
    on first use: joins and groupings that have the certificate among their keys need no
    shuffle. Both must have the same number of buckets."""
    root = ensure_tables(spark, sf_dir)
    tag = f"{root.rsplit('-', 1)[1]}_{buckets}"
    found = []
    for name in ("observations", "certificates"):
        table = f"{name}_by_cert_{tag}"
        with _LOCK:
            if not spark.catalog.tableExists(table):
                # dealt by the buckets' own hash, so each bucket is one file
                rows = spark.read.parquet(f"{root}/{name}").repartition(buckets, "cert_hash")
                (rows.write.bucketBy(buckets, "cert_hash").sortBy("cert_hash").option("path", f"{root}/{table}")
                 .mode("overwrite").saveAsTable(table))
        found.append(spark.table(table))
    return found[0], found[1]
