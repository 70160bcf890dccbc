"""Starting streams and watching their progress."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from spanwise.streaming.state import check_manifest

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ZONE = "spark.sql.session.timeZone"
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

# Rows of a micro-batch that the console shows; they pass through the driver.
CONSOLE_ROWS = 1000


@contextmanager
def _settings(spark: SparkSession, **conf: str | None) -> Iterator[None]:
    """Set session options for the block; a query keeps those it was started with."""
    names = {"provider": _PROVIDER, "partitions": _PARTITIONS, "zone": _ZONE, "changes": _CHANGES}
    wanted = {names[k]: v for k, v in conf.items() if v is not None}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_stream(
    df: DataFrame,
    sink: str | Callable[[DataFrame, int], None] = "console",
    checkpoint: str | None = None,
    mode: str = "append",
    trigger: str | None = "1 second",
    name: str | None = None,
    provider: str | None = _ROCKSDB,
    partitions: int | None = None,
    settings: dict | None = None,
) -> StreamingQuery:
    """Start a stream.

    ``sink`` is ``"console"`` (the first ``CONSOLE_ROWS`` of a micro-batch, untruncated), ``"memory"`` (small results; table ``name``),
    ``"noop"``, a function for ``foreachBatch``, or the path of a Parquet folder. ``trigger`` is a
    processing-time interval, or None to take what is there and stop. ``checkpoint`` is the folder
    to resume from: keep it between runs, and use a new one when the query changes. ``provider`` is
    the state store; the operators with Python state need RocksDB. ``partitions`` sets the number
    of state partitions, which a checkpoint keeps for life. ``settings`` are kept in the checkpoint on the first start; one
    that finds others there, or another provider, is refused. State is written as changes, not as whole snapshots.
    """
    if settings is not None and checkpoint is not None:
        check_manifest(df.sparkSession, checkpoint, settings | {"provider": provider})
    writer = df.writeStream.outputMode(mode)
    if callable(sink):
        writer = writer.foreachBatch(sink)
    elif sink == "console":
        writer = writer.format("console").option("truncate", "false").option("numRows", CONSOLE_ROWS)
    elif sink in ("memory", "noop"):
        writer = writer.format(sink)
    else:
        writer = writer.format("parquet").option("path", sink)
    if name is not None:
        writer = writer.queryName(name)
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    width = None if partitions is None else str(partitions)
    with _settings(df.sparkSession, provider=provider, partitions=width, changes="true"):
        return writer.start()


def progress(query: StreamingQuery) -> list[dict]:
    """One row per micro-batch that the query remembers (Spark keeps the last 100): batch id, input rows, rows per
    second, latency, watermark, state rows, late rows. A ``Monitor`` sees every one."""
    return [_figures(p) for p in query.recentProgress]


def _figures(p) -> dict:
    """The figures of a micro-batch, from its progress as an object of Spark or as the mapping of its JSON."""

    def of(part, name):
        return part.get(name) if isinstance(part, dict) else getattr(part, name)

    rate = of(p, "processedRowsPerSecond")
    states = of(p, "stateOperators")
    return {
        "batch_id": of(p, "batchId"),
        "input_rows": of(p, "numInputRows"),
        "rows_per_second": None if rate is None else float(rate),
        "latency_ms": of(p, "durationMs").get("triggerExecution", 0),
        "watermark": of(p, "eventTime").get("watermark"),
        "state_rows": sum(of(s, "numRowsTotal") for s in states),
        "late_rows": sum(of(s, "numRowsDroppedByWatermark") for s in states),
    }


class Monitor(StreamingQueryListener):
    """Passes the figures of every micro-batch to a function as they come (``print`` by default).

    Register with ``spark.streams.addListener(Monitor())``.
    """

    def __init__(self, show: Callable[[dict], None] = print) -> None:
        self._show = show
        self.runtime_ms = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.runtime_ms += p.durationMs.get("triggerExecution", 0)
        self._show(_figures(p))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, or else below the warehouse: both are shared by a cluster, where the
    warehouse must not be a folder of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stream_result(build: Callable[[str], DataFrame], spark: SparkSession, purpose: str = "stream",
                  partitions: int | None = None, closing: DataFrame | None = None, resume: bool = False) -> DataFrame:
    """Run a stream over all that its source holds now and return what it emitted, as a batch frame.

    ``build`` gets the name of a folder of Parquet files that its source reads too. ``closing``, rows far later than all
    others, go there. A source that takes all files at once reads them with the others: no row is late of the first
    batch, and the watermark then passes every window and slice of the source, so only those of the closing rows stay open. With
    ``resume`` the stream stops when it has taken all else, and goes on from its checkpoint for the closing rows. The
    result is written by the executors to a shared folder and read from there.
    """
    folder = shared_folder(spark, purpose)
    run_to_end(build, spark, folder, partitions, closing, resume)
    with _settings(spark, zone="UTC"):
        schema = build(f"{folder}/closing").schema
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def run_to_end(build: Callable[[str], DataFrame], spark: SparkSession, folder: str, partitions: int | None = None,
               closing: DataFrame | None = None, resume: bool = False, sink: Callable[[DataFrame, int], None] | None = None,
               mode: str = "append") -> list[dict]:
    """Run a stream to the end of a bounded source, with its rows, checkpoint and closing rows below ``folder``; the figures of its
    last run's micro-batches."""
    partitions = partitions or spark.sparkContext.defaultParallelism
    if closing is not None:
        (closing.limit(0) if resume else closing).write.parquet(f"{folder}/closing")
    with _settings(spark, partitions=str(partitions), zone="UTC"):
        df = build(f"{folder}/closing")

        def run() -> list[dict]:
            query = run_stream(df, sink or f"{folder}/rows", f"{folder}/checkpoint", mode, trigger=None)
            query.awaitTermination()
            return progress(query)

        figures = run()
        if closing is not None and resume:
            closing.write.mode("append").parquet(f"{folder}/closing")
            figures = run()
    return figures
