"""A landing folder: rows of a table as files that arrive in event-time order.

The streams read folders. To run them over a stored table as if its rows had come in
day by day, the table is written once, partitioned by day, and the files' times are set
to the order of their days (a file stream takes files by their time). A heartbeat row,
which has a time and nothing else, may follow: like the heartbeat messages of a
live feed it moves the watermark on, so that the last windows close.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.session import shared_path


def _set_arrival(spark: SparkSession, path: str) -> None:
    """File times by arrival: one second apart for each ``arrival=N`` folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/arrival=*/*.parquet")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    began = int(time.time()) - 86_400
    for status in fs.globStatus(place) or []:
        turn = int(re.search(r"/arrival=(\d+)/", str(status.getPath()))[1])
        fs.setTimes(status.getPath(), (began + turn) * 1000, -1)


def land(df: DataFrame, time_col: str = "seen_at", heartbeat_hours: int | None = None, late: DataFrame | None = None, columns: list[str] | None = None) -> str:
    """Write ``df`` as a landing folder below the shared folder; returns its path.

    Each day's rows arrive together, days in order; ``late`` rows (same columns)
    arrive after all of them, and then, with ``heartbeat_hours``, a heartbeat that
    many hours after the newest row. The times become zoned timestamps (UTC), which
    watermarks need. An empty table gives an empty folder but for the heartbeat."""
    spark = df.sparkSession
    columns = columns or df.columns
    path = shared_path(spark, f"landing-{uuid.uuid4().hex}")
    rows = df.select(*columns).withColumn(time_col, F.col(time_col).cast("timestamp"))
    day = F.datediff(F.col(time_col), F.lit("1970-01-01"))
    first, last, newest = rows.agg(F.min(day), F.max(day), F.max(time_col)).first()
    rows.withColumn("arrival", day - F.lit(first)).hint("rebalance", F.col("arrival")).write.partitionBy("arrival").parquet(path)
    after = 0 if last is None else last - first + 1
    if late is not None:
        typed = late.select(*columns).withColumn(time_col, F.col(time_col).cast("timestamp"))
        typed.withColumn("arrival", F.lit(after)).coalesce(1).write.mode("append").partitionBy("arrival").parquet(path)
    if heartbeat_hours is not None and newest is not None:
        beat = rows.agg((F.max(time_col) + F.expr(f"INTERVAL {heartbeat_hours} HOURS")).alias(time_col), F.lit(after + 1).alias("arrival"))
        blank = beat.select(*[F.col(c) if c == time_col else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns], "arrival")
        blank.write.mode("append").partitionBy("arrival").parquet(path)
    _set_arrival(spark, path)
    return path
