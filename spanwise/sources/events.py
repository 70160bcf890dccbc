"""The four span tables derived from the shared ``events`` table.

Each event is one span: it starts at ``ts`` and lasts 1 + floor(20 * value) seconds. Only
narrow projections, so they fold into the Parquet scan of whatever query uses them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanwise.functions import to_packed
from spanwise.operators.signals import split_spans


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str, closing: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """The same table as a stream; ``ts`` becomes TIMESTAMP, which watermarks need.

    ``closing`` is a second folder of the same rows, for the row that ends a bounded run. ``files_per_batch`` limits what one
    micro-batch takes, and so what its state and tasks hold.
    """
    schema = events(spark, sf_dir).schema

    def read(path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)

    # As a pattern the path may be one file as well as a folder of files.
    rows = read(f"{sf_dir}/event[s].parquet")
    if closing is not None:
        rows = rows.unionByName(read(closing))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def portions(df: DataFrame, folder: str, portion: Column, n: int, rows_per_file: int = 200_000) -> int:
    """Write a frame to ``folder`` in ``n`` portions, one after the other, as a stream will read them; files per portion.

    ``portion`` numbers the rows' portions from 0. Every portion has the same number of files, so a limit of that many
    files to a micro-batch takes one portion at a time. A file is what one task writes and reads. A portion with too few rows for
    its files gets empty ones.
    """
    spark, files = df.sparkSession, max(1, -(-df.count() // (n * rows_per_file)))
    for number in range(n):
        df.where(portion == number).repartition(files).write.mode("append").parquet(folder)
        written = len(spark.read.schema(df.schema).parquet(folder).inputFiles()) if files > 1 else number + 1
        for _ in range((number + 1) * files - written):
            df.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return files


def portion_by_time(df: DataFrame, n: int) -> Column:
    """Number of the equal stretch of ``ts``, of ``n`` between the first and the last, that holds a row."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = df.agg(F.min(micros), F.max(micros)).first()
    if first is None:
        return F.lit(0)
    span = F.lit(last - first + 1).cast("long")
    return F.call_function("div", (micros - F.lit(first)) * F.lit(n).cast("long"), span).cast("int")


def folder_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int) -> DataFrame:
    """Portions as a stream, ``files_per_batch`` files to a micro-batch; ``ts`` becomes TIMESTAMP."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def dense(df: DataFrame, factor: int) -> DataFrame:
    """The events with the distance of ``ts`` to 1970 divided by ``factor``, in whole microseconds.

    All rows are kept, and closer together: windows and gaps of seconds so have something to find.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    scaled = F.timestamp_micros(F.call_function("div", micros, F.lit(factor).cast("long")))
    return df.withColumn("ts", scaled.cast(df.schema["ts"].dataType))


def closing_event(df: DataFrame, ended: bool) -> DataFrame:
    """An event of nobody ten years after the last one of ``df``; no row if it is empty.

    One that has not ``ended`` gives a start alone, so that it forms no span of its own.
    """
    value = F.lit(0.0) if ended else F.lit(None)
    row = df.agg(F.max("ts").alias("last")).where("last IS NOT NULL").select(
        F.lit(-1).alias("event_id"), F.expr("last + INTERVAL 10 YEARS").alias("ts"), F.lit(-1).alias("user_id"),
        F.lit("closing").alias("event_type"), value.alias("value"), F.lit('{"k": 0}').alias("props"))
    return row.select([F.col(f.name).cast(f.dataType) for f in df.schema.fields])


def _end_time():
    seconds = F.floor(F.col("value") * 20).cast("int") + 1
    return F.timestamp_add("SECOND", seconds, F.col("ts"))


def mono_calls(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("event_id").alias("unique_id"),
        F.col("user_id").alias("calling_party"),
        F.col("ts").alias("start_time"),
        _end_time().alias("end_time"),
        F.when(F.col("event_type") == "error", "failed").otherwise("connected").alias("disposition"),
    )


def mono_towers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    digit = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return df.select(
        *keep,
        F.col("user_id").alias("unique_id"),
        F.concat(F.lit("T"), (digit % 10 + 1).cast("string")).alias("tower_id"),
        F.col("ts").alias("start_time"),
        _end_time().alias("end_time"),
    )


def bi_calls(df: DataFrame) -> DataFrame:
    return split_spans(mono_calls(df), "unique_id", "start_time", "end_time",
                       keep=["calling_party", "disposition"])


def bi_towers(df: DataFrame) -> DataFrame:
    return split_spans(mono_towers(df), "unique_id", "start_time", "end_time", keep=["tower_id"])


def with_packed(df: DataFrame, **columns: str) -> DataFrame:
    """Add packed-digit twins: ``with_packed(df, start_ts="start_time")``."""
    return df.withColumns({packed: to_packed(column) for packed, column in columns.items()})
