"""Back-to-back spans on a stream: the previous span in event-time order, across micro-batches.

Two stateful steps:

1. A windowed aggregation gathers the rows of each (key, slice of event time). When the watermark has passed a slice its rows
   leave it in order, and each is compared with the one before by array functions: no Python. Matches go on, and of
   every key and slice one edge: its first start and its last end.
2. Edges look up the end that their key's slice before has left, in a state keyed by the key. Nothing is read or written
   but the entries of keys that arrived, and an entry is one number, so a key with any share of all rows weighs as
   much as another. What nothing can follow any more is dropped as it is seen; a timer sweeps entries of keys that never come again.
   Where very many keys arrive together, the entries are read in one go unless they are far more than those keys.

Spans of a known greatest length need no second step where a slice is as long as the time over which one of them may be followed: step 1
then gathers, with the rows of a slice, the last row from that time before it.

All slices that end below the watermark leave step 1 in the same micro-batch, and rows below it are refused as late, so
step 2 sees slices in order. A lane is a hash group of keys, which spreads the cost of a Python call over many of them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from spanwise.durations import to_micros

# Hash groups of keys, whatever the number of partitions that hold them.
LANES = 64

# Stands for the end of a span without one: later than every start, so that nothing follows it.
_NO_END = 2**62

# From so many keys of a lane on, its entries are read in one go, as long as there are not more than so many to a key.
_MANY_KEYS, _ENTRIES_A_KEY = 500, 10

# Entries of keys that do not come again are looked for once in so many slices.
_SWEEP_SLICES = 16

# The processors travel to the executors as code: this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def back_to_back_stream(
    df: DataFrame,
    key: str | Sequence[str],
    start: str,
    end: str,
    id: str,
    max_gap_s: int = 10,
    allow_zero: bool = True,
    slice_s: int = 60,
    lanes: int = LANES,
    closes: tuple[str, str] | None = None,
    longest: str | None = None,
) -> DataFrame:
    """Streaming twin of ``back_to_back`` with the same columns.

    ``start`` must carry a watermark. Where another column does, ``closes`` names it and how far it lies behind ``start`` at
    most; it must grow with ``start`` (``rebuild_spans`` adds such a column). A pair is emitted once the watermark has
    passed the slice of ``slice_s`` seconds in which its second span starts: a longer slice emits later and costs fewer
    edges, and bounds what one key brings to a task; the pairs are the same. ``lanes`` is the number of hash groups of
    keys. Both are plain numbers that no session setting changes, and must stay the same for the life of a
    checkpoint (``run_stream`` checks that). ``longest`` promises that no span is longer: where ``slice_s`` is at least that, the gap
    and the lag of ``closes`` together, the look back takes one aggregation, without Python and ``lanes``. Needs the RocksDB
    state store, which ``run_stream`` selects.
    """
    keys = [key] if isinstance(key, str) else list(key)
    column, lag = closes or (start, None)
    lag_us = 0 if lag is None else to_micros(lag)
    limit_us, least_us = (max_gap_s + 1) * 1_000_000, 0 if allow_zero else 1
    row = F.struct(
        F.unix_micros(start).alias("start_us"), F.col(f"`{id}`").alias("row_id"),
        F.unix_micros(F.col(end).cast("timestamp")).alias("end_us"))
    timed = df.where(F.col(start).isNotNull() & F.col(column).isNotNull())
    named = [F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(keys)]
    prev_end, begin = F.timestamp_micros("prev_us"), F.timestamp_micros("start_us")
    found = [prev_end.alias("prev_end"), begin.alias("start_time"), F.timestamp_diff("SECOND", prev_end, begin).alias("gap_s")]
    if longest is not None:
        reach_us = lag_us + limit_us + to_micros(longest)
        if reach_us <= slice_s * 1_000_000:
            pairs = _follow_within_reach(timed, named, column, row, slice_s * 1_000_000, reach_us, limit_us, least_us)
            return pairs.select(*(F.col(f"key_{i}").alias(name) for i, name in enumerate(keys)), F.col("row_id").alias(id), *found)

    sliced = (
        timed.groupBy(F.window(column, f"{slice_s} seconds").alias("slice"), *named)
        .agg(F.sort_array(F.collect_list(row)).alias("rows")))

    def match(before: Column, now: Column) -> Column:
        return F.struct(F.lit(True).alias("match"), now.start_us.alias("start_us"), now.row_id.alias("row_id"),
                        before.end_us.alias("prev_us"), F.lit(_NO_END).alias("last_us"))

    count, rows = F.size("rows"), F.col("rows")
    first, last = F.get(rows, F.lit(0)), F.get(rows, count - 1)
    matches = F.filter(F.zip_with(F.slice(rows, 1, count - 1), F.slice(rows, 2, count - 1), match), _follows(least_us, limit_us))
    edge = F.struct(F.lit(False).alias("match"), first.start_us.alias("start_us"), first.row_id.alias("row_id"),
                    F.lit(_NO_END).alias("prev_us"), F.coalesce(last.end_us, F.lit(_NO_END)).alias("last_us"))
    edges = sliced.select(
        F.window_time("slice").alias("event"), F.unix_micros("slice.end").alias("slice_end_us"),
        *(f"key_{i}" for i in range(len(keys))), F.inline(F.concat(matches, F.array(edge))))

    # Own names inside: the rows reach Python as named tuples, which rename some columns.
    fields = [_Field(edges, f"key_{i}", name) for i, name in enumerate(keys)]
    fields.append(_Field(edges, "row_id", id))
    name = F.concat(*(_text(f"key_{i}") for i in range(len(keys))))
    # Matches need no state, so they may go anywhere: spread them by their row.
    lane = F.when(F.col("match"), lanes + F.pmod(F.xxhash64("row_id", "start_us"), F.lit(lanes)).cast("int"))
    sent = edges.select(
        F.coalesce(lane, F.pmod(F.xxhash64(name), F.lit(lanes)).cast("int")).alias("lane"),
        F.when(~F.col("match"), name).otherwise(F.lit("")).alias("name"), "event", "slice_end_us",
        *[c for field in fields for c in field.sent], "start_us", "prev_us", "last_us")
    kinds = {f.name: f.dataType for f in sent.schema.fields}
    inner = [c for field in fields for c in field.inner]
    pairs = T.StructType([T.StructField(c, kinds[c]) for c in [*inner, "start_us", "prev_us"]])
    carry = _Carry(lanes, limit_us, least_us, slice_s * 1_000_000, lag_us, pairs.fieldNames())
    stitched = sent.groupBy("lane").transformWithStateInPandas(carry, pairs, "Append", "EventTime")
    return stitched.select(*[field.received for field in fields], *found)


def _follows(least_us: int, limit_us: int) -> Callable[[Column], Column]:
    def within(pair: Column) -> Column:
        gap = pair.start_us - pair.prev_us
        return (gap >= least_us) & (gap < limit_us)

    return within


def _follow_within_reach(timed: DataFrame, named: Sequence[Column], column: str, row: Column, slice_us: int, reach_us: int,
                         limit_us: int, least_us: int) -> DataFrame:
    """Matches of spans that nothing can follow any more once ``reach_us`` has passed from their start.

    A window is a slice and the reach before it. Of the rows there only the last can be the one before the slice's first row. All
    of them count for that, whenever they end: an earlier row that ends later is not the one before.
    """
    window = F.window(column, f"{slice_us + reach_us} microseconds", f"{slice_us} microseconds", f"{-reach_us % slice_us} microseconds")
    slice_start = F.unix_micros("window.end") - slice_us
    placed = timed.select(window.alias("window"), F.unix_micros(column).alias("closes_us"), *named, row.alias("row"))
    own = F.col("closes_us") >= slice_start
    gathered = (
        placed.where(own | (F.col("row.start_us") >= slice_start - reach_us))
        .groupBy("window", *(f"key_{i}" for i in range(len(named))))
        .agg(F.sort_array(F.collect_list(F.when(own, F.col("row")))).alias("own"), F.max(F.when(~own, F.col("row"))).alias("before")))

    def match(before: Column, now: Column) -> Column:
        return F.struct(now.start_us.alias("start_us"), now.row_id.alias("row_id"), before.end_us.alias("prev_us"))

    count, rows = F.size("rows"), F.col("rows")
    matches = F.filter(F.zip_with(F.slice(rows, 1, count - 1), F.slice(rows, 2, count - 1), match), _follows(least_us, limit_us))
    listed = F.concat(F.array_compact(F.array("before")), F.col("own")).alias("rows")
    keys = [f"key_{i}" for i in range(len(named))]
    return gathered.where(F.size("own") > 0).select(*keys, listed).select(*keys, F.inline(matches))


def _text(column: str) -> Column:
    """A key as text that no other value and no neighbour can give: its length and itself, or a dash."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


class _Field:
    """A column on its way through pandas, where a number next to a missing one becomes a float.

    Numbers are sent without gaps, next to a flag that tells which of them are missing.
    """

    def __init__(self, df: DataFrame, inner: str, name: str) -> None:
        kind, column = df.schema[inner].dataType, F.col(inner)
        if isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
            missing = f"{inner}_missing"
            self.inner = [missing, inner]
            self.sent = [column.isNull().alias(missing), F.coalesce(column, F.lit(0).cast(kind)).alias(inner)]
            self.received = F.when(~F.col(missing), F.col(inner)).alias(name)
        else:
            self.inner, self.sent = [inner], [column]
            self.received = F.col(inner).alias(name)


class _Carry(StatefulProcessor):
    """Step 2: compare the first row of a key's slice with the last row of its slice before."""

    def __init__(self, lanes: int, limit_us: int, least_us: int, slice_us: int, lag_us: int, output: list[str]) -> None:
        self._lanes, self._limit_us, self._least_us = lanes, limit_us, least_us
        self._slice_us, self._lag_us, self._output = slice_us, lag_us, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ends = handle.getMapState("ends", "name string", "end_us long")
        self._sweeping = handle.getValueState("sweeping", "at_ms long")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        if int(key[0]) >= self._lanes:
            for batch in rows:
                yield batch[self._output]
            return
        edges = pd.concat(list(rows), ignore_index=True).sort_values(["name", "start_us"], ignore_index=True)
        names, ends = edges["name"].to_numpy(), edges["last_us"].to_numpy()
        first = np.append(True, names[1:] != names[:-1])
        last = np.append(first[1:], True)
        # Rows still to come start at or after the newest slice seen here.
        floor_us = max(int(edges["slice_end_us"].max()), self._passed_us(timerValues)) - self._lag_us
        prev, held = np.roll(ends, 1), self._held(names[first])
        prev[first] = [held.get(name, _NO_END) for name in names[first]]
        for i in np.flatnonzero(last):
            if self._may_be_followed(int(ends[i]), floor_us):
                self._ends.updateValue((names[i],), (int(ends[i]),))
            elif names[i] in held:
                self._ends.removeKey((names[i],))
        gap = edges["start_us"].to_numpy() - prev
        match = (prev != _NO_END) & (gap >= self._least_us) & (gap < self._limit_us)
        if match.any():
            yield edges.assign(prev_us=prev)[match][self._output]
        if not self._sweeping.exists() and self._ends.exists():
            self._sweep_later(timerValues)

    def handleExpiredTimer(
        self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        floor_us = self._passed_us(timerValues) - self._lag_us
        entries, dead = 0, []
        for name, end in self._ends.iterator():
            entries += 1
            if not self._may_be_followed(end[0], floor_us):
                dead.append(name)
        if len(dead) < entries:
            for name in dead:
                self._ends.removeKey(name)
            self._sweep_later(timerValues)
        else:
            self._ends.clear()
            self._sweeping.clear()
        return iter(())

    def _held(self, names: np.ndarray) -> dict[str, int]:
        """The ends held of these keys, perhaps among others. A call costs as much as tens of entries read in a row."""
        if len(names) >= _MANY_KEYS:
            limit = _ENTRIES_A_KEY * len(names)
            held = {name[0]: end[0] for name, end in islice(self._ends.iterator(), limit + 1)}
            if len(held) <= limit:
                return held
        found = ((name, self._ends.getValue((name,))) for name in names)
        return {name: end[0] for name, end in found if end is not None}

    def _may_be_followed(self, end_us: int, floor_us: int) -> bool:
        return end_us != _NO_END and end_us + self._limit_us > floor_us

    def _passed_us(self, timerValues: TimerValues) -> int:
        """The start of the slice that holds the watermark: slices before it are complete."""
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        return watermark_us - watermark_us % self._slice_us

    def _sweep_later(self, timerValues: TimerValues) -> None:
        at_ms = timerValues.getCurrentWatermarkInMs() + _SWEEP_SLICES * self._slice_us // 1000
        self._handle.registerTimer(at_ms)
        self._sweeping.update((at_ms,))

    def close(self) -> None:
        pass
