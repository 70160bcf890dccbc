"""Rows that stand for several equal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Longest run of equal rows that one generator call writes out.
_RUN = 100_000


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, with long runs of one row spread over tasks."""
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / _RUN))
    spread = df.withColumn("_run", F.explode(runs)).repartition(*df.columns, "_run")
    length = F.least(F.lit(_RUN).cast("long"), F.col(times) - F.col("_run") * _RUN)
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), length))).select(df.columns)
