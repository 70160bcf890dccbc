"""Duration strings such as ``"4 minutes"``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_micros(duration: str) -> int:
    """Length of a fixed duration in microseconds; calendar units (months) are not fixed."""
    micros = pd.Timedelta(duration).value // 1_000
    if micros <= 0:
        raise ValueError(f"duration must be at least one microsecond: {duration!r}")
    return micros


def interval_sql(duration: str) -> str:
    """The same length as a Spark day-time interval literal."""
    seconds, micros = divmod(to_micros(duration), 1_000_000)
    return f"INTERVAL '{seconds}.{micros:06d}' SECOND"


def slice_number(micros: Column, width: int) -> Column:
    """Number of the time slice of ``width`` microseconds that holds a time, counted from 1970.

    In whole numbers throughout: ``/`` would go through a double.
    """
    size = F.lit(width).cast("long")
    return F.call_function("div", micros - F.pmod(micros, size), size)
