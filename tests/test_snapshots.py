import json
from datetime import datetime

import pytest

from certlens.plans import snapshots as S
from certlens.schemas import FINDINGS, OBSERVATIONS
from tests.conftest import certs_df


def _tables(spark):
    seen = datetime(2024, 1, 29)
    certs = certs_df(spark, dict(cert_hash="a", issuer_cn="Issuer A", last_seen=seen),
                     dict(cert_hash="b", issuer_cn="Issuer B", last_seen=seen))
    obs = spark.createDataFrame([], OBSERVATIONS)
    fnd = spark.createDataFrame([], FINDINGS)
    return obs, certs, fnd


def test_stored_breakdown_preferred(spark):
    obs, certs, fnd = _tables(spark)
    stored = {"days": 7, "breakdowns": {"issuer_cn": {"issuer": "godaddy", "days": 7, "group_by": "issuer_cn",
                                                      "label": "issuer_common_name",
                                                      "buckets": [{"value": "Stored", "count": 99}]}}}
    snaps = spark.createDataFrame([(7, json.dumps(stored), datetime(2024, 1, 30))],
                                  "days int, payload_json string, updated_at timestamp")
    out = S.read_snapshot(spark, snaps, obs, certs, fnd, "2024-01-31 00:00:00", 7, "issuer_cn")
    assert [tuple(r) for r in S.selected_buckets(out).collect()] == [("Stored", 99)]


def test_legacy_snapshot_falls_back_to_live(spark):
    obs, certs, fnd = _tables(spark)
    snaps = spark.createDataFrame([(7, json.dumps({"days": 7}), datetime(2024, 1, 30))],
                                  "days int, payload_json string, updated_at timestamp")
    out = S.read_snapshot(spark, snaps, obs, certs, fnd, "2024-01-31 00:00:00", 7, "issuer_cn")
    assert sorted(tuple(r) for r in S.selected_buckets(out).collect()) == [("Issuer A", 1), ("Issuer B", 1)]
    with pytest.raises(ValueError):
        S.read_snapshot(spark, snaps, obs, certs, fnd, "2024-01-31 00:00:00", 30, "issuer_cn")
