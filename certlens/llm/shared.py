"""Intermediate tables in the shared folder, and small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.session import shared_path, ship_package


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read
    it back: later steps read the table instead of recomputing the lineage, also
    after an executor is lost. The folder is deleted when the application ends, or
    by ``discard``. ``lean`` saves disk: smaller files, and the shuffle files of
    ``df`` go as soon as the table is written."""
    return _kept([df], name, lean)


def keep_parts(parts: list[DataFrame], name: str) -> DataFrame:
    """One table of all parts (of one schema), written one after the other as by
    ``keep`` with ``lean``: the shuffle files of one part alone are on disk at once."""
    return _kept(parts, name, True)


def _kept(parts: list[DataFrame], name: str, lean: bool) -> DataFrame:
    spark = parts[0].sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    for df in parts:
        if lean:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
            try:
                df.select("*").write.parquet(path, mode="append", compression="zstd")  # a new frame takes the setting up
            finally:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        else:
            df.write.parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(parts[0].schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What runs inside sends at most so many rows at once to Python workers, which
    keep the memory of the largest batch they have seen."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote, after their last reader is done (what was
    made from them is written itself)."""
    for df in kept:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("llm-"):
                place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also makes the package known to Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one or two hashes (16 bytes each) that a broadcast may hold.
BROADCAST_ROWS = 4_000_000


def side(df: DataFrame) -> DataFrame:
    """A kept table of hashes as the small side of a join: broadcast up to
    ``BROADCAST_ROWS`` rows, joined by a shuffle beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_key(*cols: str) -> Column:
    """128-bit fingerprint of a row's columns (nulls differ from empty strings).
    Rows with equal columns get equal keys, so decisions that depend on these
    columns alone can be joined back by it."""
    parts = [F.when(F.col(c).isNull(), F.lit(i)).otherwise(F.lit(-1)) for i, c in enumerate(cols)]
    values = [F.col(c) for c in cols]
    return F.struct(
        F.xxhash64(F.lit(17), *values, *parts).alias("a"),
        F.xxhash64(F.lit(91), *reversed(values), *parts).alias("b"),
    )


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
