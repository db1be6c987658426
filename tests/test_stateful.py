"""Stateful streams against counting by hand: out-of-order and late rows, a hot
domain, windows across batches, eviction."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from certlens.sources import landing
from certlens.streaming import stateful as St
from certlens.streaming.jobs import file_stream

START = datetime(2024, 1, 1)
SCHEMA = "seen_at timestamp_ntz, cert_hash string, registered_domain string, issuer_key string"


def sightings(n=600, days=4):
    rng = random.Random(11)
    out = []
    for _ in range(n):
        at = START + timedelta(seconds=rng.randrange(days * 86_400))
        out.append((at, f"c{rng.randrange(40)}", rng.choice(["hot.example"] * 6 + ["a.example", "b.example", ""]), rng.choice(["i0", "i0", "i1"])))
    # gaps longer than a window, so that state is evicted and made anew
    return [r for r in out if not START + timedelta(hours=30) <= r[0] < START + timedelta(hours=58)]


def windows(rows, hours):
    held = {}
    for at, cert, domain, _ in rows:
        if domain:
            hour = at.replace(minute=0, second=0, microsecond=0)
            for k in range(hours):
                held.setdefault((hour - timedelta(hours=k), domain), set()).add(cert)
    return sorted((s, s + timedelta(hours=hours), d, len(c)) for (s, d), c in held.items())


@pytest.mark.parametrize("max_files,hours", [(1, 12), (2, 3), (None, 12)])
def test_sliding_windows(spark, max_files, hours):
    rows = sightings()
    path = landing.land(spark.createDataFrame(rows, SCHEMA), heartbeat_hours=72)
    got = St.sliding_burst_counts(spark, path, hours, max_files=max_files).collect()
    assert sorted(map(tuple, got)) == windows(rows, hours)


def test_open_windows_are_not_reported_and_late_rows_dropped(spark):
    rows = sightings()
    late = spark.createDataFrame([(START, "c-late", "a.example", "i0")], SCHEMA)
    path = landing.land(spark.createDataFrame(rows, SCHEMA), late=late)
    got = St.sliding_burst_counts(spark, path, 12, max_files=1, delay="2 hours").collect()
    closed = (max(r[0] for r in rows) - timedelta(hours=2)).replace(minute=0, second=0, microsecond=0)
    assert sorted(map(tuple, got)) == [w for w in windows(rows, 12) if w[1] <= closed]


def test_state_is_evicted(spark):
    rows = [(START + timedelta(hours=h), f"c{h}", "a.example", "i0") for h in (0, 1, 200)]
    path = landing.land(spark.createDataFrame(rows, SCHEMA), heartbeat_hours=400)
    result = St.run_to_parquet(St.burst_stream(file_stream(spark, path, 1), 12), "evict")
    assert result.state_rows <= 12
    assert sorted(map(tuple, St.result_rows(spark, result, St.BURST_ROWS).groupBy("window_end").agg(F.sum("cert_count")).select(F.sum("sum(cert_count)")).collect())) == [(36,)]


def test_a_hot_domain_is_split(spark):
    rows = [(START + timedelta(minutes=i), f"c{i}", "hot.example", "i0") for i in range(300)]
    path = landing.land(spark.createDataFrame(rows, SCHEMA), heartbeat_hours=72)
    result = St.run_to_parquet(St.burst_stream(file_stream(spark, path, None), 12), "hot")
    buckets = St.result_rows(spark, result, St.BURST_ROWS).groupBy("bucket").agg(F.max("cert_count").alias("n")).collect()
    assert len(buckets) == St.BUCKETS and sum(r.n for r in buckets) == 300 and max(r.n for r in buckets) < 150


def days(rows):
    out = {}
    for at, cert, domain, issuer in rows:
        day = at.replace(hour=0, minute=0, second=0, microsecond=0)
        c, d, n = out.setdefault((day, issuer), (set(), set(), []))
        c.add(cert), d.add(domain), n.append(1)
    return sorted((day, day + timedelta(days=1), i, len(c), len(d), len(n)) for (day, i), (c, d, n) in out.items())


@pytest.mark.parametrize("max_files", [1, 3, None])
def test_daily_distincts(spark, max_files):
    rows = sightings()
    path = landing.land(spark.createDataFrame(rows, SCHEMA), heartbeat_hours=72)
    got, late = St.tumbling_daily(spark, path, max_files)
    assert sorted(map(tuple, got.collect())) == days(rows) and late == 0


def test_late_rows_before_and_after_the_watermark(spark):
    rows = sightings()
    newest = max(r[0] for r in rows)
    in_time = [(newest - timedelta(hours=20), "c-new", "new.example", "i1"), (newest - timedelta(hours=1), rows[0][1], "a.example", "i0")]
    too_late = [(START, "c-lost", "lost.example", "i0")] * 3
    path = landing.land(spark.createDataFrame(rows, SCHEMA), heartbeat_hours=72, late=spark.createDataFrame(in_time + too_late, SCHEMA))
    got, late = St.tumbling_daily(spark, path, 1)
    assert sorted(map(tuple, got.collect())) == days(rows + in_time) and late == 3


def test_landing_of_an_empty_table(spark):
    path = landing.land(spark.createDataFrame([(START, "c", "a", "i")], SCHEMA).limit(0), heartbeat_hours=72)
    assert spark.read.schema(SCHEMA.replace("_ntz", "")).parquet(path).count() == 0


class CountedHandle:
    """State of one key in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, schema):
        return CountedState(self)

    getValueState = getMapState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class CountedState:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def __getattr__(self, name):
        def call(*args):
            self.handle.calls += 1
            if name == "appendList":
                self.value = [*(self.value or []), *args[0]]
            elif name in ("put", "update"):
                self.value = args[0]
            elif name == "clear":
                self.value = None
            else:
                return {"get": self.value, "exists": self.value is not None}[name]

        return call


@pytest.mark.parametrize("n", [3, 300])
def test_state_calls_do_not_grow_with_the_certificates(n):
    import pandas as pd

    handle, calls = CountedHandle(), []
    burst = St.BurstWindows(12)
    burst.init(handle)
    frame = pd.DataFrame({"hour": [h for h in (0, 20) for _ in range(n)], "cert_hash": [f"c{h}-{i}" for h in (0, 20) for i in range(n)]})
    assert not list(burst.handleInputRows(("d", 0), iter([frame]), None))
    for done in (15, 25, 40):
        class Now:
            getCurrentWatermarkInMs = staticmethod(lambda done=done: done * St.HOUR_MS)

        rows = pd.concat(burst.handleExpiredTimer(("d", 0), Now, None))
        calls.append((len(rows), rows["cert_count"].unique().tolist()))
        assert (burst.seen.value is None) == (done != 25)
    assert calls == [(12, [n]), (5, [n]), (7, [n])] and burst.due.value is None
    assert handle.calls < 60
