"""Keys that touch more than a given number of distinct items, per tumbling window or in all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.durations import interval_sql
from spanwise.functions import packed_bucket


def _list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def mobility(
    df: DataFrame,
    key: str | Sequence[str],
    item: str,
    time: str | None = None,
    window: str | None = "5 minutes",
    threshold: int = 5,
    approx: bool = False,
) -> DataFrame:
    """Rows (window_start, window_end, key..., distinct_items) with more than ``threshold`` items.

    ``time`` is the event-time column, be it the start or the end of the span; rows without it are
    left out. ``window=None`` counts over all time and gives no window columns. ``approx`` counts
    with a HyperLogLog sketch of fixed size.

    A batch frame is combined on (window, key, item) before its shuffle, so one busy key arrives
    as its distinct items only and these are spread over tasks. On a stream, ``time`` needs a
    watermark, and exact counting uses two chained aggregations in append mode: one state row
    per distinct item, never a growing set. Update mode allows one aggregation: use ``approx``.
    """
    keys = _list(key)
    counted = (F.approx_count_distinct(item) if approx else F.count_distinct(F.col(item)))
    counted = counted.alias("distinct_items")
    above = F.col("distinct_items") > threshold
    if window is None:
        if df.isStreaming and not approx:
            raise ValueError("a stream without a window can only be counted with approx=True")
        return df.groupBy(*keys).agg(counted).where(above)
    if time is None:
        raise ValueError("a window needs a time column")

    timed = df.where(F.col(time).isNotNull())
    if not df.isStreaming:
        # The window's start alone identifies it: a narrower key to hash and shuffle.
        start = F.window(time, window)["start"].alias("window_start")
        groups = timed.groupBy(start, *keys).agg(counted).where(above)
        end = (F.col("window_start") + F.expr(interval_sql(window))).alias("window_end")
        return groups.select("window_start", end, *keys, "distinct_items")

    bounds = F.window(time, window).alias("window")
    if approx:
        groups = timed.groupBy(bounds, *keys).agg(counted)
    else:
        seen = timed.groupBy(bounds, *keys, item).agg(F.count("*").alias("rows"))
        groups = seen.groupBy("window", *keys).agg(F.count(item).alias("distinct_items"))
    return groups.where(above).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, "distinct_items")


def mobility_upserts(
    df: DataFrame, key: str | Sequence[str], item: str, time: str, window: str = "5 minutes", threshold: int = 5,
) -> DataFrame:
    """``mobility`` for update mode on a stream, exactly: a row each time a count above ``threshold`` changes.

    Items are told apart first, one state row for each (window, key, item), and then counted, one row for each (window, key): no
    set grows. Both leave the state as the watermark passes the window. Counts only grow, so the last row of a
    (window, key) is its result (``UpsertTable`` keeps it). Missing items are not counted.
    """
    keys = _list(key)
    seen = df.where(F.col(time).isNotNull() & F.col(item).isNotNull()).select(
        F.window(time, window).alias("window"), *keys, F.col(item).alias("_item"))
    counted = seen.dropDuplicates(["window", *keys, "_item"]).groupBy("window", *keys).agg(
        F.count(F.lit(1)).alias("distinct_items"))
    return counted.where(F.col("distinct_items") > threshold).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "distinct_items")


def mobility_sketches(
    df: DataFrame, key: str | Sequence[str], item: str, time: str, window: str = "5 seconds", precision: int = 12,
) -> DataFrame:
    """A HyperLogLog sketch of the items of each (window, key): rows (window_start, key..., sketch), to be stored and merged.

    ``precision`` is the base-2 logarithm of the sketch's registers: 12 errs by about 1.6 %, and small sets are exact.
    """
    keys = _list(key)
    timed = df.where(F.col(time).isNotNull() & F.col(item).isNotNull())
    return timed.groupBy(F.window(time, window)["start"].alias("window_start"), *keys).agg(
        F.hll_sketch_agg(item, precision).alias("sketch"))


def merge_sketches(sketches: DataFrame, key: str | Sequence[str], window: str | None = None) -> DataFrame:
    """Stored sketches merged into longer windows (or over all time) without another scan of the spans: rows
    (window_start, key..., sketch). ``window`` must be a multiple of the window of the sketches."""
    keys = _list(key)
    merged = F.hll_union_agg("sketch").alias("sketch")
    if window is None:
        return sketches.groupBy(*keys).agg(merged)
    return sketches.groupBy(F.window("window_start", window)["start"].alias("window_start"), *keys).agg(merged)


def sketched_mobility(sketches: DataFrame, threshold: int = 5) -> DataFrame:
    """Keys whose sketch holds more than ``threshold`` items by estimate, as ``distinct_items``."""
    counted = sketches.withColumn("distinct_items", F.hll_sketch_estimate("sketch")).drop("sketch")
    return counted.where(F.col("distinct_items") > threshold)


def mobility_packed(
    df: DataFrame,
    key: str | Sequence[str],
    item: str,
    time_packed: str,
    width: int = 5000,
    threshold: int = 2,
    ordered: bool = True,
) -> DataFrame:
    """The same on packed digits: rows (window_start, key..., distinct_items), in that order.

    ``window_start`` is the packed bucket as a long. Values that are no numbers lie in no bucket and drop
    out. Only the rows above the threshold are sorted.
    """
    keys = _list(key)
    bucket = packed_bucket(time_packed, width)
    groups = (
        df.where(bucket.isNotNull()).groupBy(bucket.alias("window_start"), *keys)
        .agg(F.count_distinct(F.col(item)).alias("distinct_items"))
        .where(F.col("distinct_items") > threshold)
    )
    return groups.orderBy("window_start", *keys) if ordered else groups
