from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanwise.operators import merge_sketches, mobility, mobility_packed, mobility_sketches, sketched_mobility
from tests.helpers import at, bag, frame

SCHEMA = "unique_id long, area string, tower_id string, t timestamp_ntz"


def stays(spark, rows):
    return frame(spark, [(i, a, w, None if t is None else at(t)) for i, a, w, t in rows], SCHEMA)


def test_threshold_is_strict_and_windows_are_half_open(spark):
    rows = [(1, "a", f"T{n}", n) for n in range(3)] + [(2, "a", f"T{n}", n) for n in range(4)]
    rows += [(3, "a", "T1", 299.999999), (3, "a", "T2", 300)] + [(2, "a", "T1", 1.5)]
    got = mobility(stays(spark, rows), "unique_id", "tower_id", "t", "5 minutes", 2)
    assert bag(got) == {(at(0), at(300), 1, 3): 1, (at(0), at(300), 2, 4): 1}
    assert got.columns == ["window_start", "window_end", "unique_id", "distinct_items"]
    assert mobility(stays(spark, rows), "unique_id", "tower_id", "t", "5 minutes", 3).count() == 1
    per_five_seconds = mobility(stays(spark, rows), "unique_id", "tower_id", "t", "5 seconds", 0)
    assert bag(per_five_seconds.where("unique_id = 3")) == {
        (at(295), at(300), 3, 1): 1, (at(300), at(305), 3, 1): 1}


def test_missing_times_and_items(spark):
    rows = [(1, "a", "T1", 0), (1, "a", None, 1), (1, "a", "T2", None), (1, "a", "T3", 2)]
    df = stays(spark, rows)
    assert bag(mobility(df, "unique_id", "tower_id", "t", threshold=1)) == {(at(0), at(300), 1, 2): 1}
    assert bag(mobility(df, "unique_id", "tower_id", window=None, threshold=1)) == {(1, 3): 1}


def test_several_keys_and_window_lengths(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice("ab"), f"T{rng.randrange(9)}", rng.randrange(4000)) for _ in range(800)]
    df = stays(spark, rows)
    for seconds, window in ((5, "5 seconds"), (300, "5 minutes"), (3600, "1 hour")):
        seen = defaultdict(set)
        for i, a, w, t in rows:
            seen[at(t // seconds * seconds), i, a].add(w)
        want = {(*k, len(v)): 1 for k, v in seen.items() if len(v) > 1}
        exact = mobility(df, ["unique_id", "area"], "tower_id", "t", window, 1)
        approx = mobility(df, ["unique_id", "area"], "tower_id", "t", window, 1, approx=True)
        assert bag(exact.drop("window_end")) == want
        assert bag(approx.drop("window_end")) == want


def test_packed_is_sorted(spark):
    rows = [(9 - n % 3, f"T{n}", str(20251201100000000 + n * 1000)) for n in range(40)]
    df = frame(spark, rows, "unique_id long, tower_id string, end_ts string")
    got = [tuple(r) for r in mobility_packed(df, "unique_id", "tower_id", "end_ts", 5000, 1).collect()]
    assert got == sorted(got) and got
    assert all(start % 5000 == 0 and n > 1 for start, _, n in got)


def test_packed_values_that_are_no_numbers_drop_out(spark):
    rows = [(1, f"T{n}", v) for n, v in enumerate(["junk", "x", None, "20251201100000000", "20251201100001000"])]
    df = frame(spark, rows, "unique_id long, tower_id string, end_ts string")
    got = [tuple(r) for r in mobility_packed(df, "unique_id", "tower_id", "end_ts", 5000, 1).collect()]
    assert got == [(20251201100000000, 1, 2)]


def test_busy_key_is_combined_before_the_shuffle_and_spread_by_item(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 7).alias("i"),
                                  F.timestamp_micros(F.col("id")).alias("t"))
    plan = mobility(df, "k", "i", "t")._jdf.queryExecution().executedPlan().toString()
    deepest = [line for line in plan.splitlines() if "hashpartitioning" in line][-1]
    assert "i#" in deepest.split("hashpartitioning")[1]
    assert plan.index("partial_count") > 0


def test_window_needs_a_time(spark):
    with pytest.raises(ValueError, match="time column"):
        mobility(spark.range(1), "id", "id")


def test_stored_sketches_merge_without_another_scan(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), f"T{rng.randrange(3000)}", at(rng.randrange(0, 3000)), None) for _ in range(20_000)]
    rows += [(0, None, at(1), None), (1, "T1", None, None)]
    df = frame(spark, rows, "unique_id long, tower_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    small = mobility_sketches(df, "unique_id", "tower_id", "start_time", "5 seconds")
    for window in ("5 minutes", None):
        merged = sketched_mobility(merge_sketches(small, "unique_id", window), 0)
        exact = mobility(df, "unique_id", "tower_id", "start_time" if window else None, window, 0)
        keys = [c for c in ("window_start", "unique_id") if c in merged.columns]
        got = {tuple(r[k] for k in keys): r.distinct_items for r in merged.collect()}
        want = {tuple(r[k] for k in keys): r.distinct_items for r in exact.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - n) <= 0.05 * n for k, n in want.items())
        if window:
            # One pass over the spans gives the same registers, but knows in which order they were filled.
            direct = sketched_mobility(mobility_sketches(df, "unique_id", "tower_id", "start_time", window), 0)
            once = {tuple(r[k] for k in keys): r.distinct_items for r in direct.collect()}
            assert once.keys() == got.keys() and all(abs(once[k] - n) <= 0.03 * n for k, n in got.items())
