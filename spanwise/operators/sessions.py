"""Spans of one owner that follow the previous span within a small gap.

Every key is cut into fixed slices of start time, so that a key may hold any share of all rows. A first window
looks back within (key, slice); a second one takes only matches and the first and last row of each slice, and
finds for each first row the last row of the slice before. A key so brings one task the rows of
one slice, or two rows per slice. The slice is a plain parameter that changes no result.

Where keys are so sparse that nearly every row is an edge, the second window moves the whole table again. ``one_shuffle`` deals the rows
once, over ranges of (key, start), which cut a key of any size; each range looks back in order, and only matches and the first and
last row of each range go on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.durations import slice_number
from spanwise.functions import packed_gap
from spanwise.functions.packed import HOUR_UNIT
from spanwise.operators.copies import repeat_rows

# What a range passes on, in the order in which it stands among the edges.
FIRST, LAST, MATCH = range(3)


def back_to_back(
    df: DataFrame,
    key: str | Sequence[str],
    start: str,
    end: str,
    id: str,
    max_gap_s: int = 10,
    allow_zero: bool = True,
    slice_s: int = 3600,
    copies: str | None = None,
    one_shuffle: bool = False,
) -> DataFrame:
    """Spans that begin at most ``max_gap_s`` whole seconds after the previous span ended.

    "Previous" is the row before in the order (start, id) of the same key. Columns: key...,
    id, prev_end, start_time, gap_s. Seconds are cut off, so 10.999 s counts as 10; an overlap
    (start before prev_end) never matches; ``allow_zero=False`` also excludes touching spans.

    ``slice_s`` bounds what one key brings to one task; longer slices have fewer edges to stitch. ``copies``
    names a column that says how many equal rows a row stands for. ``one_shuffle`` reads the rows twice (to find the ranges) and
    moves them once, in Arrow batches; it has no ``copies``.
    """
    if one_shuffle:
        if copies is not None:
            raise ValueError("one_shuffle counts no copies")
        least_us, limit_us = 0 if allow_zero else 1, (max_gap_s + 1) * 1_000_000
        return _follow_in_ranges(df, [key] if isinstance(key, str) else list(key), start, end, id, least_us, limit_us)

    def follows(begin: Column, prev_end: Column) -> Column:
        lower = begin >= prev_end if allow_zero else begin > prev_end
        return lower & (F.timestamp_diff("SECOND", prev_end, begin) <= max_gap_s)

    def slice_of(begin: Column) -> Column:
        return slice_number(F.unix_micros(begin.cast("timestamp")), slice_s * 1_000_000)

    keys = [key] if isinstance(key, str) else list(key)
    pairs = _follow_previous(df, keys, start, end, id, follows, slice_of, copies)
    return pairs.select(
        *keys, id, "prev_end", F.col("_start").alias("start_time"),
        F.timestamp_diff("SECOND", F.col("prev_end"), F.col("_start")).alias("gap_s"))


def back_to_back_packed(
    df: DataFrame,
    key: str | Sequence[str],
    start: str,
    end: str,
    id: str,
    max_gap: int = 10_000,
    slice_width: int = HOUR_UNIT,
    copies: str | None = None,
) -> DataFrame:
    """The same on packed digits, ``0 < start - prev_end <= max_gap``, without time arithmetic.

    Columns: key..., id, prev_end, start_ts, gap. The gap is a difference of digits and so is
    larger than the true gap across a minute boundary. Values that are no numbers count as missing.
    ``slice_width`` is the slice in packed digits.
    """

    def follows(begin: Column, prev_end: Column) -> Column:
        gap = packed_gap(prev_end, begin)
        return (gap > 0) & (gap <= max_gap)

    def slice_of(begin: Column) -> Column:
        return F.call_function("div", begin, F.lit(slice_width).cast("long"))

    keys = [key] if isinstance(key, str) else list(key)
    df = df.withColumns({start: F.col(start).try_cast("long"), end: F.col(end).try_cast("long")})
    pairs = _follow_previous(df, keys, start, end, id, follows, slice_of, copies)
    return pairs.select(
        *keys, id, "prev_end", F.col("_start").alias("start_ts"),
        packed_gap(F.col("prev_end"), F.col("_start")).alias("gap"))


def _follow_previous(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    id: str,
    follows: Callable[[Column, Column], Column],
    slice_of: Callable[[Column], Column],
    copies: str | None,
) -> DataFrame:
    """Rows whose start follows the end of the row before: keys, id, _start, prev_end."""
    weight = [] if copies is None else [F.col(copies).alias("_copies")]
    rows = df.where(F.col(start).isNotNull()).select(
        *keys, id, F.col(start).alias("_start"), F.col(end).alias("_end"), *weight)
    order = ["_start", id, "_end"]
    begin, ended = F.col("_start"), F.col("_end")
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    # A struct tells "no row before" from "a row before without an end".
    looked = rows.withColumn("_slice", slice_of(begin)).withColumns({
        "_before": F.lag(F.struct(ended.alias("end"))).over(in_slice),
        "_last": F.lead(F.lit(True)).over(in_slice).isNull(),
    })
    first = F.col("_before").isNull()
    edge = first | F.col("_last")
    wanted = edge | follows(begin, F.col("_before.end"))
    if copies is not None:
        wanted = wanted | (F.col("_copies") > 1) & follows(begin, ended)

    # Edges of all slices of a key meet; other rows stay with their slice.
    in_edges = Window.partitionBy(*keys, "_lane").orderBy(*order)
    stitched = (looked.where(wanted).withColumn("_lane", F.when(~edge, F.col("_slice")))
                .withColumn("_edge_before", F.lag("_end").over(in_edges)))
    prev_end = F.when(first, F.col("_edge_before")).otherwise(F.col("_before.end"))
    if copies is not None:
        return _matches_of_copies(stitched, keys, id, prev_end, follows)
    return (stitched.select(*keys, id, "_start", prev_end.alias("prev_end"))
            .where(follows(begin, F.col("prev_end"))))


def _follow_in_ranges(
    df: DataFrame, keys: list[str], start: str, end: str, id: str, least_us: int, limit_us: int
) -> DataFrame:
    """The same over ranges of (key, start): keys, id, prev_end, start_time, gap_s."""

    def micros(column: str) -> Column:
        return F.unix_micros(F.col(column).cast("timestamp"))

    names = [f"key_{i}" for i in range(len(keys))]
    rows = df.where(F.col(start).isNotNull()).select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(id).alias("id"), micros(start).alias("start"), micros(end).alias("end"))
    order = [*names, "start", "id", "end"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    columns = [*names, "id", "start", "end", "range"]

    def look_back(batches):
        before = None  # the row before the batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not batch.num_rows:
                continue
            if before is None:
                yield from found(table.slice(0, 1), FIRST, None)
                before = table.slice(0, 1)
                table = table.slice(1)
            table = pa.concat_tables([before, table]).combine_chunks()
            now, was = table.slice(1), table.slice(0, table.num_rows - 1)
            prev = was["end"]
            match = follows(now["start"], prev)
            for name in names:
                match = pc.and_(match, same(now[name], was[name]))
            yield from found(now.filter(match), MATCH, prev.filter(match))
            before = table.slice(table.num_rows - 1)
        if before is not None:
            yield from found(before, LAST, None)

    def follows(begin, prev):
        gap = pc.subtract(begin, prev)
        return pc.fill_null(pc.and_(pc.greater_equal(gap, least_us), pc.less(gap, limit_us)), False)

    def same(a, b):
        return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))

    def found(table, kind, prev):
        prev = pa.nulls(table.num_rows, pa.int64()) if prev is None else prev
        out = table.select(columns).append_column("kind", pa.array([kind] * table.num_rows, pa.int32())).append_column("prev", prev)
        yield from out.combine_chunks().to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema.fields)
    wanted = ranges.select(*columns).mapInArrow(look_back, f"{fields}, kind int, prev long")
    # The edges of all ranges meet, two rows each; matches stay with their range.
    lane = F.when(F.col("kind") == MATCH, F.col("range"))
    last = F.lag(F.struct(*names, "end")).over(Window.partitionBy(lane).orderBy("range", "kind"))
    carried = wanted.withColumn("last", last)
    same_key = reduce(and_, [F.col(n).eqNullSafe(F.col(f"last.{n}")) for n in names])
    gap = F.col("start") - F.col("last.end")
    across = (F.col("kind") == FIRST) & same_key & (gap >= least_us) & (gap < limit_us)
    pairs = carried.where((F.col("kind") == MATCH) | across).withColumn(
        "prev", F.when(F.col("kind") == MATCH, F.col("prev")).otherwise(F.col("last.end")))
    return pairs.select(
        *(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("id").alias(id),
        F.timestamp_micros("prev").cast(df.schema[end].dataType).alias("prev_end"),
        F.timestamp_micros("start").cast(df.schema[start].dataType).alias("start_time"),
        F.call_function("div", F.col("start") - F.col("prev"), F.lit(1_000_000).cast("long")).alias("gap_s"))


def _matches_of_copies(
    rows: DataFrame, keys: list[str], id: str, prev_end: Column, follows: Callable[[Column, Column], Column]
) -> DataFrame:
    """Of ``_copies`` equal rows the first follows the row before, each other one its own copy."""
    ways = F.array(
        F.struct(prev_end.alias("prev_end"), F.lit(1).cast("long").alias("_times")),
        F.struct(F.col("_end").alias("prev_end"), (F.col("_copies") - 1).alias("_times")),
    )
    matched = (
        rows.select(*keys, id, "_start", F.inline(ways).alias("prev_end", "_times"))
        .where((F.col("_times") > 0) & follows(F.col("_start"), F.col("prev_end")))
    )
    return repeat_rows(matched, "_times").drop("_times")
