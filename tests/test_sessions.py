from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanwise.operators import back_to_back, back_to_back_packed
from tests.helpers import at, bag, brute_back_to_back, calls, frame

CALL = ("calling_party", "start_time", "end_time", "unique_id")
EVIDENCE = ("calling_party", "unique_id", "prev_end", "start_time")


def ids(df):
    return sorted(r.unique_id for r in df.collect())


def test_gap_edges(spark):
    # Per caller: a first call that ends at 100 s, then one after the gap in question.
    gaps = {1: 0, 2: 10, 3: 10.999, 4: 11, 5: -0.000001, 6: 0.000001}
    rows = [(c, c, 0, 100) for c in gaps] + [(100 + c, c, 100 + g, 200) for c, g in gaps.items()]
    df = calls(spark, rows)
    assert ids(back_to_back(df, *CALL)) == [101, 102, 103, 106]
    assert ids(back_to_back(df, *CALL, allow_zero=False)) == [102, 103, 106]
    assert ids(back_to_back(df, *CALL, max_gap_s=11)) == [101, 102, 103, 104, 106]
    row = back_to_back(df, *CALL).where("unique_id = 103").first()
    assert row.asDict() == {"calling_party": 3, "unique_id": 103, "prev_end": at(100),
                            "start_time": at(110.999), "gap_s": 10}


def test_only_the_row_before_counts(spark):
    # The call before in start order still runs, though an earlier one ended in time.
    df = calls(spark, [(1, 7, 0, 100), (2, 7, 50, 500), (3, 7, 105, 120)])
    assert ids(back_to_back(df, *CALL)) == []


def test_ties_go_by_id_and_missing_times(spark):
    df = calls(spark, [(2, 7, 0, 50), (1, 7, 0, 90), (3, 7, 55, 60),
                       (4, 8, 0, 5), (5, 8, 6, None), (6, 8, 7, 9), (7, 8, None, 8), (8, 8, 10, 11)])
    assert bag(back_to_back(df, *CALL), *EVIDENCE) == {
        (7, 3, at(50), at(55)): 1, (8, 5, at(5), at(6)): 1, (8, 8, at(9), at(10)): 1}


def test_missing_owner_is_one_group(spark):
    assert ids(back_to_back(calls(spark, [(1, None, 0, 5), (2, None, 6, 9)]), *CALL)) == [2]


def test_packed_rule(spark):
    rows = [(1, 7, "20251201095950000", "20251201095957000"),
            (2, 7, "20251201100002000", "20251201100009000"),   # 5 s on, but across the minute
            (3, 7, "20251201100019000", "20251201100020000"),   # 10 s on
            (4, 7, "20251201100020000", "20251201100021000"),   # touches: not matched
            (5, 7, " 20251201100031001", "20251201100032000")]  # 10.001 s on
    df = frame(spark, rows, "unique_id long, calling_party long, start_ts string, end_ts string")
    got = back_to_back_packed(df, "calling_party", "start_ts", "end_ts", "unique_id")
    assert bag(got) == {(7, 3, 20251201100009000, 20251201100019000, 10_000): 1}
    wide = back_to_back_packed(df, "calling_party", "start_ts", "end_ts", "unique_id", 4_045_000)
    assert ids(wide) == [2, 3, 5]


def random_calls(seed: int, n: int = 1500, copies: bool = True):
    """A third of the rows belong to caller 0; starts collide; some rows are exact copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        caller = 0 if i % 3 == 0 else rng.randrange(1, 30)
        start = rng.randrange(0, 4000) / 2
        rows.append((rng.randrange(n), caller, start, start + rng.choice([0, 0, 1, 3, 8, 30])))
    if copies:
        rows += [rows[0]] * 40 + [(9999, 0, 77.0, 77.0)] * 60 + rows[5:25]
    return rows


@pytest.mark.parametrize("allow_zero", [True, False])
@pytest.mark.parametrize("slice_s", [1, 45, 3600])
def test_slices_of_any_length_equal_brute_force(spark, allow_zero, slice_s):
    rows = random_calls(1)
    want = brute_back_to_back(rows, 3, allow_zero)
    assert want and max(want.values()) > 1 or not allow_zero
    got = back_to_back(calls(spark, rows), *CALL, max_gap_s=3, allow_zero=allow_zero, slice_s=slice_s)
    assert bag(got, *EVIDENCE) == want


def test_two_thousand_keys_are_cut_at_once(spark):
    rows = [(i, i % 2000, i // 2000 * 7, i // 2000 * 7 + 5) for i in range(20_000)]
    got = back_to_back(calls(spark, rows), *CALL, max_gap_s=2, slice_s=10)
    assert bag(got, *EVIDENCE) == brute_back_to_back(rows, 2) and got.count() == 18_000


def test_a_key_brings_one_task_a_slice_or_its_edges(spark):
    df = calls(spark, [(i, 0, i, i + 0.5) for i in range(4000)])
    got = back_to_back(df, *CALL, max_gap_s=0, slice_s=40)
    assert got.count() == 3999
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_slice") and plan.count("_lane") and "rangepartitioning" not in plan


def test_runs_of_copies_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("spanwise.operators.copies._RUN", 7)
    schema = "unique_id long, calling_party long, start_time timestamp_ntz, end_time timestamp_ntz, n long"
    df = frame(spark, [(1, 0, at(0), at(0), 50), (2, 0, at(4), at(9), 1)], schema)
    assert bag(back_to_back(df, *CALL, copies="n"), "unique_id", "prev_end") == {(1, at(0)): 49, (2, at(0)): 1}


def test_rows_that_stand_for_copies(spark):
    counts = Counter(random_calls(5, 300))
    rows = [row for row, n in counts.items() for _ in range(n)]
    merged = calls(spark, list(counts)).join(
        frame(spark, [(*row[:2], at(row[2]), at(row[3]), n) for row, n in counts.items()],
              "unique_id long, calling_party long, start_time timestamp_ntz, end_time timestamp_ntz, n long"),
        ["unique_id", "calling_party", "start_time", "end_time"])
    assert max(counts.values()) > 1
    for slice_s in (5, 3600):
        got = back_to_back(merged, *CALL, max_gap_s=3, slice_s=slice_s, copies="n")
        assert bag(got, *EVIDENCE) == brute_back_to_back(rows, 3)


def test_slices_of_packed_digits(spark):
    df = calls(spark, random_calls(2, 600)).selectExpr(
        "unique_id", "calling_party",
        "cast(date_format(cast(start_time as timestamp), 'yyyyMMddHHmmssSSS') as long) s",
        "cast(date_format(cast(end_time as timestamp), 'yyyyMMddHHmmssSSS') as long) e")
    args = ("calling_party", "s", "e", "unique_id", 3000)
    whole = bag(back_to_back_packed(df, *args, slice_width=10**12))
    assert whole and all(bag(back_to_back_packed(df, *args, slice_width=w)) == whole for w in (7000, 10_000_000))


def test_two_shuffles_and_pruned_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id unique_id", "user_id calling_party", "ts start_time", "ts end_time", "props")
    plan = back_to_back(df, *CALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "props" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_one_shuffle_equals_brute_force(spark, parts):
    rng = random.Random(int(parts))
    rows = [(i, rng.choice([None, 0, 0, *range(1, 30)]), s := rng.randrange(0, 4000) / 2, s + rng.choice([0, 1, 5, 40])) for i in range(500)]
    rows += [(600, 3, None, 1), (601, 4, 10, None), (602, 4, 11, 12), (7, 0, 3, 4), (7, 0, 3, 4)]
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for n, v in zip(before, (parts, "false")):
        spark.conf.set(n, v)
    try:
        df = calls(spark, rows)
        for options in ({}, {"allow_zero": False}, {"max_gap_s": 0}):
            got = back_to_back(df, *CALL, one_shuffle=True, **options)
            assert bag(got, *EVIDENCE) == brute_back_to_back(rows, **options)
            want = back_to_back(df, *CALL, **options)
            assert got.schema == want.schema and bag(got) == bag(want)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    with pytest.raises(ValueError, match="copies"):
        back_to_back(df, *CALL, one_shuffle=True, copies="n")


def test_one_shuffle_moves_the_rows_once_and_cuts_a_hot_key(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("unique_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("calling_party"),
        F.timestamp_seconds("id").alias("start_time"), F.timestamp_seconds(F.col("id") + 2).alias("end_time"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for n, v in zip(before, ("16", "false")):
        spark.conf.set(n, v)
    try:
        pairs = back_to_back(rows, *CALL, one_shuffle=True)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("rangepartitioning") == 1 and plan.count("Exchange") == 2
        # The second exchange is behind the look back, where matches and edges are left.
        assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow") < plan.index("Exchange rangepartitioning")
        sizes = rows.repartitionByRange("calling_party", "start_time").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 20_000 / 8
        assert pairs.count() == 6666
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
