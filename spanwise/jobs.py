"""Run a named query on a folder of span files.

    spark-submit -m spanwise.jobs mobility_mono_5s_approx /data/mono_signal_towers --stream
    python -m spanwise.jobs b2b_bi /data/bi_signal_calls --sink /out/pairs --set max_gap_s=30
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from spanwise.plans import CATALOG
from spanwise.sources import read_spans
from spanwise.streaming import Monitor, ProgressTable, run_stream


def _parse(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="spanwise.jobs", description=__doc__.splitlines()[0])
    parser.add_argument("query", choices=sorted(CATALOG))
    parser.add_argument("input", help="folder or file of the query's table")
    parser.add_argument("--format", default="csv")
    parser.add_argument("--no-header", action="store_true", help="CSV files without header lines")
    parser.add_argument("--sink", default="console", help="console, or the path of a Parquet folder")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE",
                        help="parameter of the query, e.g. threshold=3")
    parser.add_argument("--stream", action="store_true")
    parser.add_argument("--max-files", type=int, default=1, help="files per micro-batch")
    parser.add_argument("--trigger", default="1 second", help="interval, or 'once' to stop at the end")
    parser.add_argument("--mode", default="append", choices=["append", "update"])
    parser.add_argument("--checkpoint", help="folder to resume from")
    parser.add_argument("--progress", help="folder that keeps the figures of every micro-batch")
    parser.add_argument("--provider", help="class of the state store of a stream (RocksDB by default)")
    parser.add_argument("--rows", type=int, help="print so many rows of a batch result at most (all by default)")
    return parser.parse_args(argv)


def _value(text: str) -> int | str:
    return int(text) if text.lstrip("-").isdigit() else text


def _print(result: DataFrame, rows: int | None) -> None:
    """One line per row, fetched partition by partition; says so if ``rows`` leaves some out."""
    print("\t".join(result.columns))
    fetched = (result if rows is None else result.limit(rows + 1)).toLocalIterator()
    for n, row in enumerate(fetched):
        if n == rows:
            print(f"more rows follow; --rows {rows} ends here")
            return
        print("\t".join(map(str, row)))


def main(argv: Sequence[str] | None = None) -> None:
    args = _parse(argv)
    params = {name: _value(value) for name, _, value in (s.partition("=") for s in args.set)}
    spark = (
        SparkSession.builder.appName(f"spanwise {args.query}")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    query = CATALOG[args.query]
    df = read_spans(spark, args.input, query.table, args.stream, args.max_files, args.format,
                    header=not args.no_header)
    if args.stream:
        monitor = Monitor()
        listeners = [monitor] + ([Monitor(ProgressTable(spark, args.progress))] if args.progress else [])
        for listener in listeners:
            spark.streams.addListener(listener)
        trigger = None if args.trigger == "once" else args.trigger
        store = {"provider": args.provider} if args.provider else {}
        settings = {"query": args.query} | query.settings(**params)
        run = run_stream(query(df, **params), args.sink, args.checkpoint, args.mode, trigger, args.query, settings=settings, **store)
        run.awaitTermination()
        for listener in listeners:
            spark.streams.removeListener(listener)
        print(f"runtime of all micro-batches: {monitor.runtime_ms} ms")
        return
    began = time.monotonic()
    result = query(df, **params)
    if args.sink == "console":
        _print(result, args.rows)
    else:
        result.write.mode("overwrite").parquet(args.sink)
    print(f"runtime: {round((time.monotonic() - began) * 1000)} ms")


if __name__ == "__main__":
    main()
