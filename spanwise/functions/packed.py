"""Packed-digit timestamps: ``yyyyMMddHHmmssSSS`` as 17 digits.

Every function here is integer arithmetic on Catalyst expressions, so it stays inside
whole-stage code generation; no formatter and no regular expression runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: the place of each field in the 17 digits.
YEAR_UNIT = 10_000_000_000_000
MONTH_UNIT = 100_000_000_000
DAY_UNIT = 1_000_000_000
HOUR_UNIT = 10_000_000
MINUTE_UNIT = 100_000
MILLIS_PER_SECOND = 1_000


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _div(a: Column, b: int) -> Column:
    """Integer division of non-negative longs (``/`` would be fractional in Spark)."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def _field(digits: Column, unit: int, size: int) -> Column:
    return (_div(digits, unit) % F.lit(size)).cast("int")


def parse_packed(value: Column | str) -> Column:
    """Packed digits to a timestamp in the session time zone; NULL if they are not one.

    Accepts strings (surrounding blanks allowed) or longs. Impossible dates and times such as
    day 32 or second 60, signs, other lengths than 17 and non-digits all give NULL instead of an error.
    """
    column = _column(value)
    # Known when the query is planned: what is not needed for a number is planned away.
    number = F.typeof(column) == "bigint"
    text = F.trim(column.cast("string"))
    digits = F.when(number, column.try_cast("long")).otherwise(text.try_cast("long"))
    # 17 characters make a number of this size only if all of them are digits.
    in_range = (number | (F.length(text) == 17)) & digits.between(1000 * YEAR_UNIT, 10_000 * YEAR_UNIT - 1)
    below_minute = digits % MINUTE_UNIT
    second = (below_minute.cast("decimal(8,0)") / F.lit(MILLIS_PER_SECOND)).cast("decimal(16,6)")
    stamp = F.try_make_timestamp(
        _div(digits, YEAR_UNIT).cast("int"),
        _field(digits, MONTH_UNIT, 100),
        _field(digits, DAY_UNIT, 100),
        _field(digits, HOUR_UNIT, 100),
        _field(digits, MINUTE_UNIT, 100),
        second,
    )
    return F.when(in_range & (below_minute < 60 * MILLIS_PER_SECOND), stamp)


def to_packed(ts: Column | str) -> Column:
    """Timestamp to packed digits as a long; anything below a millisecond is cut off."""
    ts = _column(ts)
    # Time zones differ by whole seconds, so what is below a second needs no zone (and no decimals).
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000).cast("long"))
    fields = ((F.year, YEAR_UNIT), (F.month, MONTH_UNIT), (F.day, DAY_UNIT), (F.hour, HOUR_UNIT),
              (F.minute, MINUTE_UNIT), (F.second, MILLIS_PER_SECOND))
    packed = _div(micros, 1_000)
    for part, unit in fields:
        packed = packed + part(ts).cast("long") * F.lit(unit)
    return packed


def packed_bucket(value: Column | str, width: int = 5000) -> Column:
    """Start of the bucket of ``width`` packed digits that holds ``value``, as packed digits.

    Equal to a tumbling window only where ``width`` divides the used codes of a minute
    (5000 is five seconds) or is a whole calendar unit (1000000000 is one day).
    """
    return _div(_column(value).try_cast("long"), width) * F.lit(width)


def packed_gap(prev_end: Column | str, start: Column | str) -> Column:
    """Difference of two packed values.

    These are digits, not milliseconds: across a minute, hour or day the result is larger than
    the true gap. Kept because stored queries depend on it; see ``back_to_back`` for true time.
    """
    return _column(start).try_cast("long") - _column(prev_end).try_cast("long")
