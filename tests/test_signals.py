from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanwise.operators import rebuild_spans, split_spans
from spanwise.plans import CATALOG
from tests.helpers import at, bag, calls, signals

OK = "connected"


def test_round_trip(spark):
    rows = [(i, i % 3, i * 7.5, i * 7.5 + i % 5) for i in range(50)]
    spans = calls(spark, rows)
    split = split_spans(spans, "unique_id", "start_time", "end_time", keep=["calling_party"])
    assert split.columns == ["unique_id", "calling_party", "event_type", "event_time"]
    assert split.count() == 100
    back = rebuild_spans(split, "unique_id", ["calling_party"])
    assert bag(back.select(spans.columns)) == bag(spans)
    once = rebuild_spans(split, "unique_id", keep=["calling_party"], one_per_id=True)
    assert bag(once.select(spans.columns)) == bag(spans)


def test_split_needs_no_shuffle(spark):
    plan = split_spans(calls(spark, [(1, 1, 0, 1)]), "unique_id", "start_time", "end_time")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_lone_signals_have_no_pair(spark):
    df = signals(spark, [(1, 0, 5, 0, OK), (2, 1, 5, 3, OK), (3, 0, 5, 4, OK), (3, 1, 5, 6, OK)])
    for once in (False, True):
        got = rebuild_spans(df, "unique_id", ["calling_party"], one_per_id=once)
        assert bag(got) == {(3, 5, at(4), at(6)): 1}


def test_bound_is_inclusive_on_both_ends(spark):
    df = signals(spark, [
        (1, 0, 5, 0, OK), (1, 1, 5, 240, OK),
        (2, 0, 5, 0, OK), (2, 1, 5, 240.000001, OK),
        (3, 0, 5, 10, OK), (3, 1, 5, 10, OK),
        (4, 0, 5, 10, OK), (4, 1, 5, 9.999999, OK),
    ])
    for once in (False, True):
        got = rebuild_spans(df, "unique_id", ["calling_party"], "4 minutes", one_per_id=once)
        assert sorted(r.unique_id for r in got.collect()) == [1, 3]


def test_repeated_signals_pair_as_a_join(spark):
    df = signals(spark, [(1, 0, 5, 0, OK), (1, 0, 5, 0, OK), (1, 1, 5, 8, OK), (1, 1, 5, 9, OK)])
    want = {(1, at(0), at(8)): 2, (1, at(0), at(9)): 2}
    assert bag(rebuild_spans(df, "unique_id")) == want
    assert bag(rebuild_spans(df, "unique_id", bound="1 minute")) == want


@pytest.mark.parametrize("bound", [None, "1 minute"])
def test_copies_can_be_counted_before_they_are_paired(spark, bound):
    rows = [(1, 0, 5, 0, OK)] * 30 + [(1, 1, 5, 8, OK)] * 20 + [(1, 1, 5, 70, OK), (1, 0, 5, 2, OK)]
    rows += [(2, 0, 5, 1, OK), (2, 1, 5, 3, OK), (None, 0, 5, 1, OK), (None, 1, 5, 3, OK)]
    df = signals(spark, rows)
    plain = rebuild_spans(df, "unique_id", bound=bound)
    assert plain.count() >= 620
    counted = rebuild_spans(df, "unique_id", bound=bound, copies="n")
    assert bag(counted) == {(*pair, n): 1 for pair, n in bag(plain).items()}


@pytest.mark.parametrize("zero", [False, True])
def test_pairs_of_copies_reach_the_look_back_as_counts(spark, zero):
    rows = [(1, 0, 5, 0, OK)] * 9 + [(1, 1, 5, 0 if zero else 8, OK)] * 7 + [(2, 0, 5, 9, OK), (2, 1, 5, 10, OK)]
    df = signals(spark, rows)
    want = bag(CATALOG["b2b_bi"](df))
    assert sum(want.values()) == (63 if zero else 1)
    assert bag(CATALOG["b2b_bi"](df, count_copies=True)) == bag(CATALOG["b2b_bi"](df, slice_s=1)) == want


def test_broken_promise_raises(spark):
    df = signals(spark, [(1, 0, 5, 0, OK), (1, 1, 5, 8, OK), (1, 1, 5, 9, OK)])
    with pytest.raises(Exception, match="more than one START or END"):
        rebuild_spans(df, "unique_id", one_per_id=True).count()


def test_filter_holds_for_both_signals(spark):
    df = signals(spark, [
        (1, 0, 5, 0, OK), (1, 1, 5, 8, "failed"),
        (2, 0, 5, 0, "failed"), (2, 1, 5, 8, OK),
        (3, 0, 5, 0, OK), (3, 1, 5, 8, OK),
    ])
    got = rebuild_spans(df, "unique_id", where=F.col("disposition") == OK)
    assert [r.unique_id for r in got.collect()] == [3]


def test_keys_must_agree_and_missing_keys_do_not_pair(spark):
    df = signals(spark, [(1, 0, 5, 0, OK), (1, 1, 6, 8, OK), (2, 0, None, 0, OK), (2, 1, None, 8, OK)])
    assert rebuild_spans(df, "unique_id", ["calling_party"]).count() == 0
    assert rebuild_spans(df, "unique_id", ["calling_party"], one_per_id=True).count() == 0
    assert rebuild_spans(df, "unique_id", keep=["calling_party"]).count() == 2


def test_bounded_join_of_one_busy_id_equals_all_pairs_within_the_bound(spark):
    rng = random.Random(4)
    starts = [rng.uniform(-4000, 4000) for _ in range(120)]
    ends = [rng.uniform(-4000, 4000) for _ in range(120)] + [s + 60 for s in starts[:20]]
    rows = [(1, 0, 5, s, OK) for s in starts] + [(1, 1, 5, e, OK) for e in ends]
    got = bag(rebuild_spans(signals(spark, rows), "unique_id", bound="1 minute"))
    want: dict = {}
    for s in starts:
        for e in ends:
            if at(s) <= at(e) and (at(e) - at(s)).total_seconds() <= 60:
                want[1, at(s), at(e)] = want.get((1, at(s), at(e)), 0) + 1
    assert got == want and len(want) > 20


def test_bounded_join_uses_the_time_slice_as_a_key(spark):
    plan = rebuild_spans(signals(spark, [(1, 0, 5, 0, OK)]), "unique_id", ["calling_party"], "4 minutes")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in text and "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("bound", [None, "10 seconds"])
def test_a_hot_id_is_cut_into_blocks(spark, bound):
    rng = random.Random(8)
    rows = [(1, 0, i % 7, rng.randrange(0, 400) / 4, "x") for i in range(300)] + [(1, 1, i % 5, rng.randrange(0, 400) / 4, "x") for i in range(40)]
    rows += [(i, t, 0, i / 10 + t, "x") for i in range(2, 200) for t in (0, 1)] + [(2, 0, None, 1, "y")] * 3
    df = signals(spark, rows)
    want = bag(rebuild_spans(df, "unique_id", bound=bound, keep=["calling_party"]))
    for block_rows in (1, 7, 50, 10_000):
        assert bag(rebuild_spans(df, "unique_id", bound=bound, keep=["calling_party"], block_rows=block_rows)) == want


def test_blocks_spread_the_pairs_of_one_id(spark):
    starts = spark.range(3000).select(F.lit(5).alias("unique_id"), F.lit(0).alias("event_type"), F.timestamp_seconds("id").alias("event_time"))
    ends = spark.range(30).select(F.lit(5).alias("unique_id"), F.lit(1).alias("event_type"), F.timestamp_seconds("id").alias("event_time"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for n, v in zip(before, ("false", "16", "-1")):
        spark.conf.set(n, v)
    try:
        def largest(**options):
            pairs = rebuild_spans(starts.unionByName(ends), "unique_id", **options)
            return [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().orderBy(F.desc("count")).collect()]

        assert largest() == [90_000]
        spread = largest(block_rows=100)
        assert sum(spread) == 90_000 and spread[0] < 30_000 and len(spread) >= 8
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
