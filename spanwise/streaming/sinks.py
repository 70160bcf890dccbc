"""Tables that a stream keeps: upserts, late rows and progress. Each micro-batch has a folder of its own number, so one that is
repeated after a failure replaces what its first try left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.durations import interval_sql, slice_number, to_micros


class UpsertTable:
    """A function sink for update mode: ``run_stream(df, table, mode="update")``.

    Every micro-batch brings the rows whose figures changed. ``folded`` gives the last row of each key.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def folded(self, spark: SparkSession, keys: Sequence[str]) -> DataFrame:
        rows = spark.read.parquet(self.path)
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        last = F.max_by(F.struct(*rest), "batch").alias("last")
        return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


class LateTable:
    """A function sink that parts each micro-batch by the watermark of all batches before it.

    The watermark is the newest ``time`` of those batches less ``delay``, and a row is late if its time is not beyond it. With a
    ``window`` a row is late only if the tumbling window that holds it ends at or before the watermark. Late rows
    carry the watermark that refused them; rows without a time are late of nothing and stay with the others. What comes
    out on time is what a query with the same delay accepts, as that one learns of a watermark no sooner.
    """

    def __init__(self, path: str, time: str, delay: str, window: str | None = None) -> None:
        self.path, self._time, self._delay, self._window = path, time, delay, window

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        watermark = self._watermark(spark, batch)
        micros = F.unix_micros(F.col(self._time).cast("timestamp"))
        if self._window is not None:
            width = to_micros(self._window)
            micros = (slice_number(micros, width) + 1) * F.lit(width)
        late = F.lit(False) if watermark is None else F.coalesce(F.timestamp_micros(micros) <= watermark, F.lit(False))
        refused = F.when(late, F.lit(None if watermark is None else watermark).cast("timestamp"))
        folder = f"{self.path}/rows/batch={batch}"
        rows.withColumns({"late": late, "refused_by": refused}).write.partitionBy("late").mode("overwrite").parquet(folder)
        # The newest time of the batch, from the rows as written.
        written = spark.read.schema(rows.select(self._time).schema).parquet(folder)
        written.agg(F.max(self._time).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/newest/batch={batch}")

    def _watermark(self, spark: SparkSession, batch: int):
        if batch == 0:
            return None
        before = spark.read.schema("newest timestamp, batch long").parquet(f"{self.path}/newest").where(F.col("batch") < batch)
        return before.agg((F.max("newest") - F.expr(interval_sql(self._delay))).alias("w")).first()["w"]

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows so far: the columns of the stream, ``batch``, ``late`` and ``refused_by``."""
        rows = spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.withColumn("late", F.col("late").cast("boolean"))


class ProgressTable:
    """Keeps the figures of every micro-batch: ``spark.streams.addListener(Monitor(ProgressTable(spark, path)))``."""

    SCHEMA = ("batch_id long, input_rows long, rows_per_second double, latency_ms long, watermark string, state_rows long, "
              "late_rows long")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path

    def __call__(self, figures: dict) -> None:
        row = [tuple(figures[c.split()[0]] for c in self.SCHEMA.split(", "))]
        self._spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/batch={figures['batch_id']}")

    def read(self) -> DataFrame:
        return self._spark.read.schema(self.SCHEMA).parquet(self.path)
