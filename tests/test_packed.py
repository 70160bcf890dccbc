from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.functions import packed_bucket, packed_gap, parse_packed, to_packed

CASES = [
    ("20251201095950000", datetime(2025, 12, 1, 9, 59, 50)),
    ("  20251201095950123 ", datetime(2025, 12, 1, 9, 59, 50, 123000)),
    ("20240229235959999", datetime(2024, 2, 29, 23, 59, 59, 999000)),
    ("20251132000001123", None),
    ("20250229000000000", None),
    ("20251301000000000", None),
    ("20251201240000000", None),
    ("20251201096000000", None),
    ("20251201095960000", None),
    ("2025120109595000", None),
    ("202512010959500001", None),
    ("+2025120109595000", None),
    ("020251201100002000", None),
    ("000020251201100002000", None),
    ("+20251201100002000", None),
    ("-2025120109595000", None),
    ("2025120109595000.5", None),
    ("junk", None),
    ("", None),
    (None, None),
]


def test_parse_text(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    got = {r.i: r.t for r in df.select("i", parse_packed("v").alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_parse_long(spark):
    df = spark.createDataFrame([(20251201095957001,)], "v long")
    assert df.select(parse_packed("v")).first()[0] == datetime(2025, 12, 1, 9, 59, 57, 1000)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(datetime(1971, 1, 1), datetime(9999, 1, 1)), min_size=50, max_size=50))
def test_round_trip_cuts_to_milliseconds(spark, times):
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    packed = to_packed("t")
    rows = df.select("t", packed.alias("p"), F.date_format(F.col("t").cast("timestamp"), "yyyyMMddHHmmssSSS").alias("f"),
                     parse_packed(packed).alias("back")).collect()
    for r in rows:
        assert str(r.p) == r.f
        assert r.back == r.t.replace(microsecond=r.t.microsecond // 1000 * 1000)


def test_bucket_is_the_five_second_window(spark):
    df = spark.range(0, 200_000, 7).select(
        F.timestamp_micros(F.lit(1_764_583_100_000_000) + F.col("id") * 1_000_000).alias("t"))
    df = df.withColumn("p", to_packed("t"))
    other = df.select(packed_bucket("p").alias("b"), to_packed(F.window("t", "5 seconds")["start"]).alias("w"))
    assert other.where("b <> w").count() == 0


@pytest.mark.parametrize("end, start, gap", [
    ("20251201095957000", "20251201100002000", 4_045_000),
    ("20251201100000000", "20251201100005000", 5_000),
])
def test_gap_is_a_difference_of_digits(spark, end, start, gap):
    df = spark.createDataFrame([(end, start)], "e string, s string")
    assert df.select(packed_gap("e", "s")).first()[0] == gap
