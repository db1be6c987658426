import json
import os
import tempfile

from pyspark.sql import Observation, functions as F

from certlens.sources import psl
from certlens.sources.envelope import parse_messages, split_quarantine
from tests.conftest import SMOKE


def test_load_rules_from_list_file(spark):
    text = "// comment\n\ncom\nuk\nco.uk\n*.ck\n!www.ck\nexample.test  trailing words\n"
    path = os.path.join(tempfile.mkdtemp(), "psl.dat")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    rules = psl.load_rules(spark, path)
    assert rules == ["com", "uk", "co.uk", "*.ck", "!www.ck", "example.test"]
    hosts = spark.createDataFrame([("a.b.example.co.uk",), ("x.example.test",), ("q.w.e.ck",)], "host string")
    got = {r[0]: r[1] for r in psl.registered_domain_table(hosts, psl.rules_frame(spark, rules), "host",
                                                          len(rules)).collect()}
    assert got == {"a.b.example.co.uk": "example.co.uk", "x.example.test": "x.example.test", "q.w.e.ck": "w.e.ck"}


def test_envelope_filters_and_quarantines(spark):
    msgs = [
        {"message_type": "certificate_update", "data": {"leaf_cert": {"as_der": "", "der": "AAEC"},
                                                       "chain": [{"cert": ""}, {"der": "AwQ="}], "seen": 1.5,
                                                       "source": {"name": "", "url": "https://log"}}},
        {"message_type": "heartbeat", "data": {}},
        {"message_type": "certificate_update", "data": {"leaf_cert": {"as_der": "not*base64"}}},
        {"message_type": "certificate_update", "data": {"leaf_cert": {}}},
    ]
    df = spark.createDataFrame([(json.dumps(m),) for m in msgs], "value string")
    parsed = parse_messages(df)
    good, bad = split_quarantine(parsed)
    g = good.first()
    assert good.count() == 1 and bad.count() == 1
    assert bytes(g["leaf_der"]) == b"\x00\x01\x02" and g["log_id"] == "https://log"
    assert len(g["chain_der"]) == 1 and g["seen_at"] is not None
    seen = Observation()
    parse_messages(df, counters=seen).collect()
    assert seen.get == {"received_events": 3, "no_leaf": 1, "undecodable": 1}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaves_are_joined_without_a_broadcast(spark):
    """A leaf is larger than the customer row that its size is estimated from; of the
    chain's certificates, three at most, only these are encoded."""
    from certlens.sources import adapters as A

    plan = plan_of(A.der_messages(spark, SMOKE))
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
    assert "c_custkey#" in plan.split("BroadcastExchange")[1] and "<= 2" in plan.split("BroadcastExchange")[1]


def test_encoding_is_dealt_out_and_features_join_without_a_broadcast(spark):
    from certlens.plans.queries_scalars import certificate_features

    plan = plan_of(certificate_features(spark, SMOKE))
    assert "Broadcast" not in plan
    for encode in plan.split("MapInPandas _encode")[1:]:
        assert "REPARTITION_BY_COL" in encode.split("MapInPandas")[0].split("FileScan")[0]
