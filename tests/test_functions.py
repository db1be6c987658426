import pytest
from pyspark.sql import functions as F

from certlens.functions.certcols import anomaly_bucket, finding_code_label, san_count_bucket, validity_bucket
from certlens.functions.timewin import Span
from certlens.plans.reports import merge_single_rows


def test_date_range_validation():
    with pytest.raises(ValueError):
        Span.dates("2024-01-10", "2024-01-09")
    s = Span.dates("2024-01-09", "2024-01-09")
    assert (s.end - s.start).days == 1


def test_merge_single_rows(spark):
    a = spark.createDataFrame([(1, 2)], "x long, y long")
    b = spark.createDataFrame([("z",)], "z string")
    assert tuple(merge_single_rows(a, b).first()) == (1, 2, "z")


def test_finding_code_labels(spark):
    df = spark.createDataFrame([("ZLINT_E_SUBJECT_CN",), ("ZLINT_SUBJECT",), ("",), ("SAN_MISSING",)], "c string")
    got = [r[0] for r in df.select(finding_code_label(F.col("c"))).collect()]
    assert got == ["ZLint: subject cn", "ZLint: zlint subject", "none", "san missing"]


def test_buckets(spark):
    df = spark.createDataFrame([(0, 0, 90), (1, 10, 91), (5, 30, 397), (26, 60, 398)], "n int, s int, v int")
    rows = df.select(san_count_bucket("n"), anomaly_bucket("s"), validity_bucket("v")).collect()
    assert [tuple(r) for r in rows] == [("2-5", "0-9", "0-90"), ("1", "10-29", "91-180"),
                                         ("2-5", "30-59", "181-397"), ("26+", "60+", "398+")]
