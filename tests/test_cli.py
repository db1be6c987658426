"""End to end: DER messages -> ingest stream -> rollup -> reports -> rescore."""

import json
import uuid

from certlens import cli
from certlens.session import shared_path
from certlens.sources import adapters as A
from certlens.sources import psl
from tests.conftest import SMOKE

AS_OF = "2024-01-31 00:00:00"


def test_cli_pipeline(spark, capsys):
    work = shared_path(spark, f"cli-{uuid.uuid4().hex[:8]}")
    A.der_messages(spark, SMOKE).repartition(2).write.parquet(f"{work}/messages")
    with open(f"{work}/suffixes.dat", "w", encoding="utf-8") as handle:
        handle.write("\n".join(psl.FIXTURE_RULES))
    suffixes = ["--suffix-list", f"{work}/suffixes.dat"]
    base = ["--tables", f"{work}/tables", "--as-of", AS_OF]
    cli.main(base + ["ingest", "--source", f"{work}/messages", "--issuer", "building", "--issuer", "machinery", *suffixes])
    cli.main(base + ["rollup", "--days", "30"])
    capsys.readouterr()
    cli.main(base + ["query-issuer-stats", "--days", "7"])
    stats = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert stats["cert_count"] > 0 and stats["dv_count"] + stats["ov_count"] + stats["ev_count"] + \
        stats["unknown_validation_count"] > 0
    cli.main(base + ["query-anomalies", "--days", "14", "--limit", "3"])
    top = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert 0 < len(top) <= 3 and all(0 < t["anomaly_score"] <= 100 for t in top)
    before = spark.read.parquet(f"{work}/tables/cert_findings").count()
    cli.main(base + ["rescore-anomalies", "--days", "14", "--limit", "10", "--fast", *suffixes])
    assert spark.read.parquet(f"{work}/tables/cert_findings").count() > before
    counters = spark.read.parquet(f"{work}/tables/counters").agg({"received_events": "sum"}).first()[0]
    assert counters == 1000
