from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

T0 = datetime(2025, 12, 1, 10, 0, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(microseconds=round(seconds * 1_000_000))


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def calls(spark: SparkSession, rows) -> DataFrame:
    """(id, caller, start s, end s) with offsets from T0, or None."""
    data = [(i, c, None if s is None else at(s), None if e is None else at(e)) for i, c, s, e in rows]
    return frame(spark, data, "unique_id long, calling_party long, start_time timestamp_ntz, end_time timestamp_ntz")


def signals(spark: SparkSession, rows) -> DataFrame:
    """(id, type, caller, time s, disposition)."""
    data = [(i, t, c, at(s), d) for i, t, c, s, d in rows]
    return frame(spark, data, "unique_id long, event_type int, calling_party long, event_time timestamp_ntz, disposition string")


def bag(df: DataFrame, *columns: str) -> Counter:
    picked = df.select(*columns) if columns else df
    return Counter(tuple(r) for r in picked.collect())


def brute_back_to_back(rows, max_gap_s: int = 10, allow_zero: bool = True) -> Counter:
    """(caller, id, prev_end, start) by sorting each caller's rows in plain Python."""
    by_caller: dict = {}
    for i, c, s, e in rows:
        if s is not None:
            by_caller.setdefault(c, []).append((s, i, e))
    found: Counter = Counter()
    for caller, spans in by_caller.items():
        spans.sort(key=lambda r: (r[0], r[1], float("-inf") if r[2] is None else r[2]))
        for (_, _, prev), (start, i, _) in zip(spans, spans[1:]):
            if prev is None:
                continue
            gap = round((start - prev) * 1_000_000)
            if (gap >= 0 if allow_zero else gap > 0) and gap < (max_gap_s + 1) * 1_000_000:
                found[caller, i, at(prev), at(start)] += 1
    return found
