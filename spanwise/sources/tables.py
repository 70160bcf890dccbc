"""The four span tables: layouts, readers (batch and streaming) and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions import parse_packed


@dataclass(frozen=True)
class Table:
    """Layout of one table: file header, column name and type, in file order."""

    folder: str
    fields: tuple[tuple[str, str, T.DataType], ...]
    times: tuple[tuple[str, str], ...]

    @property
    def file_schema(self) -> T.StructType:
        return T.StructType([T.StructField(header, kind, True) for header, _, kind in self.fields])

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, kind, True) for _, name, kind in self.fields])

    @property
    def columns(self) -> list[str]:
        return [name for _, name, _ in self.fields]


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()

# Headers, order and folders of the file format.
TABLES = {
    "mono_calls": Table(
        "mono_signal_calls",
        (
            ("Unique ID", "unique_id", _LONG),
            ("Calling Party", "calling_party", _LONG),
            ("Called Party", "called_party", _LONG),
            ("Start Time", "start_ts", _TEXT),
            ("End Time", "end_ts", _TEXT),
            ("Duration (sec)", "duration", _INT),
            ("Disposition", "disposition", _TEXT),
            ("IMEI", "imei", _LONG),
        ),
        (("start_ts", "start_time"), ("end_ts", "end_time")),
    ),
    "bi_calls": Table(
        "bi_signal_calls",
        (
            ("Unique ID", "unique_id", _LONG),
            ("Event Type", "event_type", _INT),
            ("Calling Party", "calling_party", _LONG),
            ("Called Party", "called_party", _LONG),
            ("Timestamp", "event_ts", _TEXT),
            ("Disposition", "disposition", _TEXT),
            ("IMEI", "imei", _LONG),
        ),
        (("event_ts", "event_time"),),
    ),
    "mono_towers": Table(
        "mono_signal_towers",
        (
            ("Unique ID", "unique_id", _LONG),
            ("Tower", "tower_id", _TEXT),
            ("Start Timestamp", "start_ts", _TEXT),
            ("End Timestamp", "end_ts", _TEXT),
        ),
        (("start_ts", "start_time"), ("end_ts", "end_time")),
    ),
    "bi_towers": Table(
        "bi_signal_towers",
        (
            ("Unique ID", "unique_id", _LONG),
            ("Tower", "tower_id", _TEXT),
            ("Event Type", "event_type", _INT),
            ("Timestamp", "event_ts", _TEXT),
        ),
        (("event_ts", "event_time"),),
    ),
}


def read_spans(
    spark: SparkSession,
    path: str,
    table: str,
    streaming: bool = False,
    max_files: int | None = None,
    fmt: str = "csv",
    header: bool = True,
    ingestion_time: bool = False,
) -> DataFrame:
    """Read one of ``TABLES`` from a folder (or file) and add its parsed timestamps.

    CSV columns are matched to their header (``enforceSchema=false``: a file with other headers
    fails rather than shifting its data), blanks around values are ignored, and fields that do
    not parse become NULL. ``header=False`` reads merged files whose header lines were removed.
    ``max_files`` limits a stream to that many files per micro-batch. A streamed folder must hold
    finished files only: a file is read once. ``ingestion_time`` adds the time of processing, which
    differs from run to run.
    """
    layout = TABLES[table]
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        raw = (
            reader.schema(layout.file_schema)
            .option("header", header)
            .option("enforceSchema", not header)
            .option("mode", "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .csv(path)
            .toDF(*layout.columns)
        )
    else:
        raw = reader.schema(layout.schema).format(fmt).load(path)
    parsed = raw.withColumns({time: parse_packed(packed) for packed, time in layout.times})
    return parsed.withColumn("ingestion_time", F.current_timestamp()) if ingestion_time else parsed


def read_checked(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """CSV files of one of ``TABLES`` in two halves: rows of sound lines, as ``read_spans`` gives them, and a quarantine.

    The quarantine has a row for each line that is not sound: ``file``, ``line`` (from 1, header and blank lines included),
    ``record`` and ``fault``: ``cells`` for too few or too many, or the first column whose value does not parse, packed times
    included. Header lines are known by their text and skipped, and so are blank lines; a file with another header has it in the
    quarantine. Files are read in blocks like any others: lines are counted within a block, and blocks are summed up.
    """
    layout = TABLES[table]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    blank = F.length(F.trim("value")) == 0
    header = F.col("value") == ",".join(h for h, _, _ in layout.fields)
    schema = ", ".join(f"{name} {kind.simpleString()}" for _, name, kind in layout.fields) + ", _record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", "ignoreLeadingWhiteSpace": "true",
               "ignoreTrailingWhiteSpace": "true"}
    parsed = lines.where(~blank & ~header).withColumn("row", F.from_csv("value", F.lit(schema), options))
    cells = F.split("value", ",", -1)
    whole = F.size(cells) == len(layout.fields)
    bad = F.coalesce(*(
        F.when(F.col(f"row.{name}").isNull() & (F.trim(F.get(cells, F.lit(i))) != ""), F.lit(name))
        for i, (_, name, _) in enumerate(layout.fields)),
        *(F.when(F.col(f"row.{packed}").isNotNull() & parse_packed(F.col(f"row.{packed}")).isNull(), F.lit(packed))
          for packed, _ in layout.times))
    # A cell in quotes may hold commas: such a line is only faulty if the parser says so too.
    broken = F.col("row._record").isNotNull()
    fault = F.when(broken & ~whole, F.lit("cells")).otherwise(F.coalesce(bad, F.when(broken, F.lit("cells"))))
    judged = parsed.withColumn("fault", fault)

    sound = judged.where(F.col("fault").isNull()).select("row.*").drop("_record")
    rows = sound.withColumns({time: parse_packed(packed) for packed, time in layout.times})
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    faulty = judged.where(F.col("fault").isNotNull()).join(blocks, ["file", "block"])
    line = (F.col("before") + F.col("at") - F.col("first") + 1).alias("line")
    return rows, faulty.select("file", line, F.col("value").alias("record"), "fault")


def write_spans(df: DataFrame, path: str, table: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a frame with the columns of ``table`` in its file layout, replacing what was there."""
    layout = TABLES[table]
    out = df.select([F.col(name).cast(kind) for _, name, kind in layout.fields])
    if fmt == "csv":
        out.toDF(*[h for h, _, _ in layout.fields]).write.mode(mode).option("header", True).csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def register_tables(spark: SparkSession, base: str, fmt: str = "csv", header: bool = True) -> None:
    """Create or replace one temporary view per table over the folders below ``base``."""
    for name, layout in TABLES.items():
        df = read_spans(spark, f"{base}/{layout.folder}", name, fmt=fmt, header=header)
        df.createOrReplaceTempView(name)
