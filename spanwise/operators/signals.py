"""Spans to START/END signals and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.durations import interval_sql, slice_number, to_micros

START, END = 0, 1

# Windows of a stream's pairs start so many bounds apart. Each reaches one bound into the next, so of three ENDs two wait
# in one window and one in two.
WINDOW_BOUNDS = 2

# Time slices of a bounded join are this many bounds wide, so that about one START in sixteen
# reaches into a second slice and the START side grows by about 6 %.
_SLICE_BOUNDS = 16


def split_spans(df: DataFrame, id: str, start: str, end: str, keep: Sequence[str] = ()) -> DataFrame:
    """One START (0) and one END (1) row per span: id, keep..., event_type, event_time.

    A narrow map: it needs no shuffle, in batch or on a stream.
    """
    signals = F.array(
        F.struct(F.lit(START).alias("event_type"), F.col(start).alias("event_time")),
        F.struct(F.lit(END).alias("event_type"), F.col(end).alias("event_time")),
    )
    return df.select(id, *keep, F.inline(signals).alias("event_type", "event_time"))


def rebuild_spans(
    df: DataFrame,
    id: str,
    keys: Sequence[str] = (),
    bound: str | None = None,
    where: Column | None = None,
    keep: Sequence[str] = (),
    one_per_id: bool = False,
    time: str = "event_time",
    copies: str | None = None,
    one_scan: bool = False,
    closes: str | None = None,
    block_rows: int | None = None,
    window_bounds: int = WINDOW_BOUNDS,
) -> DataFrame:
    """Pair each START with the ENDs of equal ``id`` and ``keys``: id, keys, keep, start_time, end_time.

    ``bound`` admits only ends within ``[start, start + bound]``; ``where`` filters both kinds of
    signal before they are paired; ``keep`` names columns taken from the START. Repeated signals of
    one id pair up as in an inner join. With ``copies`` equal signals are counted before they are joined, so that
    copies never meet pair by pair, and a column of that name tells how many equal pairs a row stands for.

    With a bound the join also uses a time slice as a key, so that an id with very many signals is
    spread over tasks by time and only slices that can match meet. Without a bound the join is on
    the id alone, and adaptive execution splits a skewed id. ``one_per_id`` promises at most one
    START and one END per id and keys: the source is then read once and combined before its single
    shuffle; a broken promise raises an error at run time rather than losing pairs. ``block_rows`` cuts an id (of a time slice) with
    more STARTs or ENDs than that into blocks of about so many: every block of STARTs meets every block of ENDs in a place of its own,
    so the pairs of one id spread over tasks. Counts are one more aggregation of the join's keys, and only ids above the
    limit are copied. Equal signals fall into one block; ``copies`` counts them.

    On a stream a bound is required and ``time`` must carry a watermark: both let old signals leave the state. A pair leaves
    as its second signal comes, from a join of the stream with itself that reads the source twice; its watermark column is
    ``start_time``. With ``one_scan`` the source is read once: an aggregation gathers the signals of an id in windows that
    overlap by the bound, and pairs leave when the watermark has passed their window. ``closes`` then names a column to add,
    which carries the watermark on: a time that grows with ``start_time`` and lies ``stream_lag(bound, window_bounds)`` behind it at most. The
    windows are ``window_bounds`` bounds apart: the more, the fewer ENDs wait in two of them and the later pairs leave. It lays out the
    state, so it must stay the same for the life of a checkpoint.
    """
    signals = df if where is None else df.where(where)
    if df.isStreaming and (bound is None or one_per_id):
        raise ValueError("a stream needs a bound, and cannot use one_per_id")
    if one_per_id:
        return _rebuild_grouped(signals, id, keys, bound, keep, time)

    if one_scan:
        if not df.isStreaming:
            raise ValueError("one_scan is for streams; one_per_id reads a batch frame once")
        return _rebuild_stream(signals, id, keys, bound, keep, time, closes, window_bounds)

    on = [id, *keys]
    starts = signals.where(F.col("event_type") == START).select(
        *on, *keep, F.col(time).alias("start_time"))
    ends = signals.where(F.col("event_type") == END).select(*on, F.col(time).alias("end_time"))
    if df.isStreaming:
        # One watermark column only: operators further down take start_time as their event time.
        pairs = _pair(starts, ends, on, bound)
        pairs = pairs.withColumn("end_time", F.timestamp_micros(F.unix_micros("end_time")))
        return pairs.select(*on, *keep, "start_time", "end_time")

    if copies is None:
        return _pair(starts, ends, on, bound, block_rows).select(*on, *keep, "start_time", "end_time")
    return _pair(
        starts.groupBy(starts.columns).agg(F.count("*").alias("_starts")),
        ends.groupBy(ends.columns).agg(F.count("*").alias("_ends")),
        on, bound, block_rows,
    ).select(*on, *keep, "start_time", "end_time", (F.col("_starts") * F.col("_ends")).alias(copies))


def _pair(starts: DataFrame, ends: DataFrame, on: list[str], bound: str | None, block_rows: int | None = None) -> DataFrame:
    if bound is None:
        return _meet(starts, ends, on, block_rows)
    last_end = F.col("start_time") + F.expr(interval_sql(bound))
    first, last = _slice(F.col("start_time"), bound), _slice(last_end, bound)
    starts = starts.withColumn(
        "_slice", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    ends = ends.withColumn("_slice", _slice(F.col("end_time"), bound))
    return _meet(starts, ends, [*on, "_slice"], block_rows).where(
        (F.col("end_time") >= F.col("start_time")) & (F.col("end_time") <= last_end))


def _meet(starts: DataFrame, ends: DataFrame, on: list[str], block_rows: int | None) -> DataFrame:
    """An inner join on ``on``, with large keys cut into blocks of rows."""
    if block_rows is None:
        return starts.join(ends, on)

    def blocks(side: DataFrame, name: str) -> DataFrame:
        count = F.count(F.lit(1)) + F.lit(block_rows - 1)
        return side.groupBy(*on).agg(F.call_function("div", count, F.lit(block_rows).cast("long")).alias(name))

    large = blocks(starts, "_n_starts").join(blocks(ends, "_n_ends"), on).where("_n_starts > 1 OR _n_ends > 1")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in a block of its side, once for every block of the other side."""
        block = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(f"_n{own}"), F.lit(1)))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"_n{other}"), F.lit(1)) - 1)
        return side.join(large, on, "left").select(*side.columns, block.alias(own), F.explode(every).alias(other))

    cells = ["_starts_block", "_ends_block"]
    return (dealt(starts, "_starts", "_ends").withColumnsRenamed(dict(zip(("_starts", "_ends"), cells)))
            .join(dealt(ends, "_ends", "_starts").withColumnsRenamed(dict(zip(("_starts", "_ends"), cells))), [*on, *cells]))


def _slice(time: Column, bound: str) -> Column:
    return slice_number(F.unix_micros(time.cast("timestamp")), _SLICE_BOUNDS * to_micros(bound))


def stream_lag(bound: str, window_bounds: int = WINDOW_BOUNDS) -> str:
    """How far the time at which a pair leaves a stream lies behind its start at most."""
    return f"{(window_bounds + 1) * to_micros(bound)} microseconds"


def _rebuild_stream(signals, id, keys, bound, keep, time, closes, window_bounds) -> DataFrame:
    """A START waits in the window that holds it before its last bound; every END that its bound admits falls into that window."""
    on = [id, *keys]
    is_start, is_end = F.col("event_type") == START, F.col("event_type") == END
    apart, length = (f"{n * to_micros(bound)} microseconds" for n in (window_bounds, window_bounds + 1))
    shared = F.col("_window.start") + F.expr(interval_sql(apart))
    paired = reduce(and_, [F.col(c).isNotNull() for c in on], is_start | is_end)
    windowed = signals.where(paired).withColumn("_window", F.window(time, length, apart))
    waiting = windowed.where(is_end | (F.col(time) < shared)).groupBy("_window", *on).agg(
        F.collect_list(F.when(is_start, F.struct(F.col(time).alias("start_time"), *keep))).alias("_starts"),
        F.collect_list(F.when(is_end, F.col(time))).alias("_ends"))
    left = [] if closes is None else [F.window_time("_window").alias(closes)]
    started = waiting.where(F.size("_ends") > 0).select(*left, *on, "_ends", F.inline("_starts"))
    within = F.filter("_ends", lambda end: (end >= F.col("start_time")) & (
        end <= F.col("start_time") + F.expr(interval_sql(bound))))
    return started.select(*on, *keep, "start_time", F.explode(within).alias("end_time"), *([closes] if closes else []))


def _rebuild_grouped(signals, id, keys, bound, keep, time) -> DataFrame:
    on = [id, *keys]
    is_start, is_end = F.col("event_type") == START, F.col("event_type") == END
    paired = reduce(and_, [F.col(c).isNotNull() for c in on], is_start | is_end)
    spans = signals.where(paired).groupBy(*on).agg(
        *[F.max(F.when(is_start, F.col(c))).alias(c) for c in keep],
        F.max(F.when(is_start, F.col(time))).alias("start_time"),
        F.max(F.when(is_end, F.col(time))).alias("end_time"),
        F.count_if(is_start).alias("_starts"),
        F.count_if(is_end).alias("_ends"),
    )
    starts, ends = F.col("_starts"), F.col("_ends")
    broken = F.raise_error(F.lit("one_per_id: an id has more than one START or END")).cast("boolean")
    pairs = spans.where(F.when((starts > 1) | (ends > 1), broken).otherwise((starts == 1) & (ends == 1)))
    if bound is not None:
        last_end = F.col("start_time") + F.expr(interval_sql(bound))
        pairs = pairs.where((F.col("end_time") >= F.col("start_time")) & (F.col("end_time") <= last_end))
    return pairs.select(*on, *keep, "start_time", "end_time")
