"""Maintenance of the ingested tables, in the folders that their readers read."""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from certlens.functions.timewin import as_datetime
from certlens.operators.latest import latest_versions


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    fs, place = _files(spark, pattern)
    return [str(s.getPath()) for s in fs.globStatus(place) or []]


def drop_expired_days(spark: SparkSession, root: str, as_of, days: int = 30) -> list[str]:
    """Delete the day folders of observations that lie wholly before the
    retention window. A day leaves once its last moment is out of the window; no
    data is read or rewritten."""
    first = (as_datetime(as_of) - timedelta(days=days)).date()
    gone = []
    for folder in _folders(spark, f"{root}/observations/batch_id=*/seen_day=*"):
        day = re.search(r"seen_day=(\d{4}-\d\d-\d\d)$", folder)
        if day and date.fromisoformat(day[1]) < first:
            fs, place = _files(spark, folder)
            fs.delete(place, True)
            gone.append(folder)
    return gone


def compact_certificates(spark: SparkSession, root: str) -> int:
    """Replace the certificate versions of all batches but the newest (which may
    be replayed) by their latest ones, under a negative batch id below all others.

    The new folder appears before the old ones go; a run that stops in between
    leaves versions twice, which readers of the latest version don't notice.
    Returns the new batch id (0: nothing to do)."""
    ids = sorted(int(re.search(r"batch_id=(-?\d+)$", f)[1]) for f in _folders(spark, f"{root}/certificates/batch_id=*"))
    old = [i for i in ids if i < max(ids, default=0) or i < 0]
    if len(old) < 2:
        return 0
    new = min(0, ids[0]) - 1
    rows = spark.read.parquet(f"{root}/certificates").filter(F.col("batch_id").isin(old))
    staged = f"{root}/_compact-{uuid.uuid4().hex}"
    latest_versions(rows).drop("batch_id").write.parquet(staged)
    fs, source = _files(spark, staged)
    fs.rename(source, _files(spark, f"{root}/certificates/batch_id={new}")[1])
    for i in old:
        fs.delete(_files(spark, f"{root}/certificates/batch_id={i}")[1], True)
    return new
