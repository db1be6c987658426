"""Physical-plan properties the scale design relies on."""

import __spark_entry__ as E
from certlens.sources import adapters as A
from tests.conftest import SMOKE


def _plan(df, mode="formatted"):
    import contextlib
    import io

    df.collect()  # AQE: the explained plan is the final, re-optimised one
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_window_filters_reach_the_scan(spark):
    plan = _plan(E.queries()["breakdown_registered_domain_days"](spark, SMOKE))
    assert "PartitionFilters: [isnotnull(seen_day" in plan
    assert "GreaterThanOrEqual(seen_at," in plan
    assert "ReadSchema: struct<seen_at:timestamp_ntz,cert_hash:string,registered_domain:string>" in plan


def test_baselines_are_broadcast_not_shuffled_on_issuer(spark):
    """Certificates meet the per-issuer baselines through a broadcast; the
    only shuffles on issuer_key are the full outer joins that combine the
    three one-row-per-issuer baseline aggregates."""
    import re

    # what ran: the sizes are measured first, so the initial plan still sorts and merges
    plan = _plan(E.queries()["anomaly_score"](spark, SMOKE), "simple").split("== Initial Plan ==")[0]
    assert re.search(r"BroadcastHashJoin \[issuer_key#\d+\], \[issuer_key#\d+\], LeftOuter", plan)
    for join_type in re.findall(r"SortMergeJoin \[issuer_key#\d+\], \[issuer_key#\d+\], (\w+)", plan):
        assert join_type == "FullOuter"


def test_latest_version_is_an_aggregate(spark):
    df = A.derive_certificates(spark, SMOKE, columns=["last_seen", "anomaly_score"])
    plan = _plan(df, "simple")
    assert "max_by" in plan and "Window" not in plan


def test_daily_rollup_scans_each_table_once(spark):
    import re

    plan = _plan(E.queries()["issuer_daily_rollup"](spark, SMOKE), "simple")
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", final)) == 2


def test_certificate_lookup_reads_one_range(spark):
    from certlens.sources import store

    certs = store.read(spark, SMOKE, "certificates")
    some = certs.select("cert_hash").first()[0]
    plan = _plan(certs.filter(certs.cert_hash == some))
    assert f"EqualTo(cert_hash,{some})" in plan


def test_scoring_plan_is_built_without_a_job(spark):
    """Building the query runs nothing; the base tables are written before."""
    E.queries()["anomaly_score"](spark, SMOKE)  # writes the base tables and reads their schemas
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scoring-plan", "build")
    E.queries()["anomaly_score"](spark, SMOKE)
    assert not tracker.getJobIdsForGroup("scoring-plan")
    spark.sparkContext.setJobGroup("other", "other")


def test_colocated_rollup_has_no_exchange_below_the_join(spark):
    plan = E.queries()["issuer_daily_rollup_colocated"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    join = next(i for i, line in enumerate(lines) if "Join " in line)
    assert "SortMergeJoin [cert_hash" in lines[join] or "BroadcastHashJoin" in lines[join]
    below = "\n".join(lines[join + 1:])
    assert "Exchange" not in below.replace("BroadcastExchange", "") and "Bucketed: true" in below


def _row_groups(spark, path, cert):
    """Row groups of the files of ``path`` in all, and those that their Bloom filters
    leave for a certificate."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = [s.getPath() for s in place.getFileSystem(conf).globStatus(place)]
    column = jvm.org.apache.parquet.filter2.predicate.FilterApi.binaryColumn("cert_hash")
    wanted = jvm.org.apache.parquet.filter2.predicate.FilterApi.eq(column, jvm.org.apache.parquet.io.api.Binary.fromString(cert))
    options = (jvm.org.apache.parquet.HadoopReadOptions.builder(conf).useStatsFilter(False).useDictionaryFilter(False).useBloomFilter(True)
               .withRecordFilter(jvm.org.apache.parquet.filter2.compat.FilterCompat.get(wanted)).build())
    whole = left = filters = 0
    for f in files:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f, conf)
        every = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        whole += every.getRowGroups().size()
        for block in every.getFooter().getBlocks():
            filters += sum(c.getBloomFilterOffset() > 0 for c in block.getColumns() if c.getPath().toDotString() == "cert_hash")
        every.close()
        some = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source, options)
        left += some.getRowGroups().size()
        some.close()
    return whole, left, filters


def test_bloom_filters_leave_few_row_groups(spark):
    from certlens.sources import store

    root = store.ensure_tables(spark, SMOKE)
    rows = store.read(spark, SMOKE, "observations").filter("cert_hash = 'cert-42'")
    days = {r.seen_day for r in rows.select("seen_day").collect()}
    whole, left, filters = _row_groups(spark, f"{root}/observations/seen_day=*/*.parquet", "cert-42")
    assert filters == whole >= 30 and len(days) <= left <= len(days) + 3 < whole
    assert _row_groups(spark, f"{root}/observations/seen_day=*/*.parquet", "no such certificate")[1] <= 2
    whole, left, filters = _row_groups(spark, f"{root}/certificate_versions/*.parquet", "no such certificate")
    assert filters == whole > 0 and left == 0
