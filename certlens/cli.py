"""Command-line jobs over a folder of stored tables (``spark-submit -m``-able).

The folder holds ``certificates`` (versions), ``observations``,
``cert_findings`` and, once rollups ran, ``issuer_daily_stats``,
``issuer_sigalg_stats`` and ``dashboard_snapshots``. Commands:

  rollup --days N                refresh rollups and dashboard snapshots (F7)
  query-issuer-stats --days N    trailing issuer statistics (G1)
  query-anomalies --days N --limit K   top anomalies (G8)
  rescore-anomalies --days N --limit K [--all-certs] [--fast]   (D18)
  ingest --source DIR [--continuous]   message stream -> tables (L1)
  retention --days N / compact        maintenance jobs (A18, compaction)

Query commands print their (bounded: one row or top-k) result as JSON lines.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession


def _now() -> str:
    return datetime.now(tz=timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _tables(spark: SparkSession, root: str):
    from certlens.operators.latest import latest_versions
    from certlens.sources.adapters import CertTables

    return CertTables(spark.read.parquet(f"{root}/observations"),
                      latest_versions(spark.read.parquet(f"{root}/certificates")),
                      spark.read.parquet(f"{root}/cert_findings"))


def _print(df) -> None:
    for line in df.toJSON().collect():  # bounded results only (one row / top-k)
        print(line)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="certlens")
    parser.add_argument("--tables", required=True, help="folder of the stored tables")
    parser.add_argument("--as-of", default=None, help="UTC time of the run (default: now)")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("rollup")
    p.add_argument("--days", type=int, default=30)
    p = sub.add_parser("refresh-rollups", help="only the days that changed since the last run")
    p.add_argument("--days", type=int, default=30)
    p = sub.add_parser("query-issuer-stats")
    p.add_argument("--days", type=int, default=30)
    p = sub.add_parser("query-anomalies")
    p.add_argument("--days", type=int, default=14)
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--report", action="store_true", help="the counts and the ranking in one row")
    p = sub.add_parser("rescore-anomalies")
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--limit", type=int, default=50_000)
    p.add_argument("--all-certs", action="store_true")
    p.add_argument("--fast", action="store_true")
    p.add_argument("--suffix-list", required=True, help="the public suffix list file")
    p = sub.add_parser("ingest")
    p.add_argument("--source", required=True)
    p.add_argument("--continuous", action="store_true")
    p.add_argument("--suffix-list", required=True, help="the public suffix list file")
    p.add_argument("--max-files", type=int, default=16, help="message files per micro-batch (rate limit)")
    p.add_argument("--issuer", action="append", default=None,
                   help="issuer-DN substring of the family to keep (repeatable; default: built-in family)")
    p = sub.add_parser("retention")
    p.add_argument("--days", type=int, default=30)
    sub.add_parser("compact")
    args = parser.parse_args(argv)

    from certlens.session import build_session

    spark = build_session(app_name=f"certlens-{args.command}")
    as_of = args.as_of or _now()
    root = args.tables.rstrip("/")

    if args.command == "rollup":
        from certlens.plans.snapshots import refresh_rollups
        t = _tables(spark, root)
        refresh_rollups(spark, t.observations, t.certificates, t.findings, root, as_of, args.days)
    elif args.command == "refresh-rollups":
        from certlens.operators.refresh import refresh_touched
        from certlens.operators.rollups import refresh_span
        t = _tables(spark, root)
        days = refresh_touched(t.observations, t.certificates, root, as_of, refresh_span(as_of, args.days), spark.read.parquet(f"{root}/certificates"))
        print(json.dumps({"days": [d.isoformat() for d in days]}))
    elif args.command == "query-issuer-stats":
        from certlens.plans.reports import issuer_stats
        t = _tables(spark, root)
        _print(issuer_stats(spark.read.parquet(f"{root}/issuer_daily_stats"), t.certificates, as_of, args.days))
    elif args.command == "query-anomalies":
        from certlens.functions.timewin import Span
        from certlens.plans.anomalies import top_anomalies
        t = _tables(spark, root)
        span = Span.trailing(as_of, args.days)
        if args.report:
            from certlens.plans.anomalies import anomalies_report
            from certlens.plans.reports import issuer_stats
            stats = issuer_stats(spark.read.parquet(f"{root}/issuer_daily_stats"), t.certificates, as_of, args.days)
            _print(anomalies_report(stats, t.findings, t.certificates, span, args.limit))
        else:
            _print(top_anomalies(t.findings, t.certificates, span, args.limit))
    elif args.command == "rescore-anomalies":
        from certlens.plans.rescore import rescore
        from certlens.sources.psl import load_rules
        t = _tables(spark, root)
        out = rescore(spark, t.observations, t.certificates, t.findings, as_of, args.days, args.limit,
                      all_certs=args.all_certs, fast=args.fast, rules=load_rules(spark, args.suffix_list))
        # Same folder layout as the ingest batches: batch_id=<int> (here the run's epoch seconds).
        run_id = int(datetime.fromisoformat(as_of).replace(tzinfo=timezone.utc).timestamp())
        out.write.mode("append").parquet(f"{root}/cert_findings/batch_id={run_id}")
    elif args.command == "ingest":
        from certlens.config import IssuerMatching
        from certlens.sources.psl import load_rules
        from certlens.streaming.ingest import run_message_ingest
        matching = IssuerMatching(issuer_substrings=tuple(args.issuer)) if args.issuer else None
        run_message_ingest(spark, args.source, root=root, matching=matching, max_files=args.max_files,
                           available_now=not args.continuous, rules=load_rules(spark, args.suffix_list))
        if args.continuous:
            spark.streams.awaitAnyTermination()
    elif args.command == "retention":
        from certlens.streaming.maintenance import drop_expired_days
        drop_expired_days(spark, root, as_of, args.days)
    elif args.command == "compact":
        from certlens.streaming.maintenance import compact_certificates
        compact_certificates(spark, root)


if __name__ == "__main__":
    main()
