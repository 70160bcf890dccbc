"""What the operators share: Arrow slices, shared tables, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
#: Rows and bytes that may be sent to every executor.
SENT_ROWS, SENT_BYTES = 500_000, 64 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts take about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
              column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply to slices of Arrow batches what ``make`` builds once in each task."""

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield step(part)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


class Kept(dict):
    """A bounded cache that, when full, keeps what was asked for again since the last time and drops the rest.

    Most distinct words of a corpus come once; those that come again make up nearly all of it.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.again = limit, set()

    def missing(self, wanted: set) -> list:
        """Those of the wanted keys that are not held; takes note of the others."""
        if len(self) >= self.limit:
            kept = {k: self[k] for k in self.again} if len(self.again) <= self.limit * 3 // 4 else {}
            self.clear()
            self.update(kept)
            self.again.clear()
        new = list(wanted - self.keys())
        self.again |= wanted.difference(new)
        return new

    def drop(self, key) -> None:
        del self[key]
        self.again.discard(key)


def own_name(name: str, taken) -> str:
    """A column name that none of the taken ones equals, in whatever case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors reach.

    Where the setting is missing, below the warehouse folder, which a session has in any case; on a cluster that must not be
    a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to a shared table and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def discard(*frames: DataFrame) -> None:
    """Remove the tables of ``stored`` frames that nothing will read any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = SENT_ROWS, size: int = SENT_BYTES) -> DataFrame:
    """A stored frame, marked for sending to all executors if it holds ``rows`` rows and ``size`` bytes at most."""
    found = df.agg(F.count(F.lit(1)), *(F.sum(_bytes(f)) for f in df.schema.fields)).first()
    return F.broadcast(df) if found[0] <= rows and sum(n or 0 for n in found[1:]) <= size else df


def _bytes(field: T.StructField):
    """About how many bytes a value takes."""
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(name)
    if isinstance(field.dataType, T.ArrayType):
        return F.size(name).cast("long") * 16
    return F.lit(8)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one pass that reads nothing else."""
    return df.select(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many pieces of about ``each`` hold ``total``."""
    return max(least, -(-total // each))
