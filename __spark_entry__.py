"""

The queries run over the whole ``events`` table, read as spans (see ``spanwise.sources.events``).
Its spans are days apart, so windows and gaps here are wider than the defaults of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import packed_bucket, packed_gap, parse_packed
from spanwise.operators import (
    merge_sketches,
    mobility_packed,
    mobility_sketches,
    mobility_upserts,
    rebuild_spans,
    sketched_mobility,
)
from spanwise.plans import CATALOG
from spanwise.sources import TABLES, read_checked, read_spans, register_tables, write_spans
from spanwise.sources import events as ev
from spanwise.streaming import LateTable, UpsertTable, run_stream, run_to_end, shared_folder, state_rows, stream_result

try:
    from spanwise.llm import registry as corpus
except ImportError:  # the folder, or a package that it needs, may be left out
    corpus = None

HOUR_S = 3600
DAY_PACKED = 1_000_000_000
DAY_S = 86_400


def _calls(spark, sf_dir):
    return ev.mono_calls(ev.events(spark, sf_dir))


def _towers(spark, sf_dir):
    return ev.mono_towers(ev.events(spark, sf_dir))


def _call_signals(spark, sf_dir):
    return ev.bi_calls(ev.events(spark, sf_dir))


def _tower_signals(spark, sf_dir):
    return ev.bi_towers(ev.events(spark, sf_dir))


#: How far the events are drawn together, so that the customary constants of the queries find something.
SECONDS_APART, MINUTES_APART = 40_000, 600


def _close_together(table, factor):
    return lambda events: table(ev.dense(events, factor))


def _dense(table, factor):
    return lambda spark, sf_dir: _close_together(table, factor)(ev.events(spark, sf_dir))


_MONO, _BI = {"start_ts": "start_time", "end_ts": "end_time"}, {"event_ts": "event_time"}


def _packed(table, factor, columns):
    return lambda spark, sf_dir: ev.with_packed(_dense(table, factor)(spark, sf_dir), **columns)


def _batch(name, table, **params):
    return lambda spark, sf_dir: CATALOG[name](table(spark, sf_dir), **params)


def _naive(df: DataFrame) -> DataFrame:
    """Timestamps as TIMESTAMP_NTZ, like those of the events table."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else df


#: Events that one state partition of a stream is sized for, and portions in which a stream takes the table.
STATE_ROWS, PORTIONS = 50_000, 4


def _partitions(spark, events: DataFrame) -> int:
    return min(spark.sparkContext.defaultParallelism, max(2, -(-events.count() // STATE_ROWS)))


def _stream(name, table, ended=False, resume=False, **params):
    """The whole result of a stream, closed by one far later event (see ``closing_event`` for ``ended``)."""

    def run(spark, sf_dir):
        events = ev.events(spark, sf_dir)

        def build(closing):
            return _naive(CATALOG[name](table(ev.events_stream(spark, sf_dir, closing)), **params))

        return stream_result(build, spark, name, _partitions(spark, events), ev.closing_event(events, ended), resume)

    return run


def _portioned(spark, sf_dir, name, portion=None):
    """The events as a stream of ``PORTIONS`` micro-batches in order of time, and one more for the closing event."""
    events, folder = ev.events(spark, sf_dir), shared_folder(spark, f"{name}_portions")
    files = ev.portions(events, folder, ev.portion_by_time(events, PORTIONS) if portion is None else portion, PORTIONS)
    ev.closing_event(events, False).write.mode("append").parquet(folder)
    return ev.folder_stream(spark, folder, events.schema, files), _partitions(spark, events)


def _portioned_stream(name, table, **params):
    """The whole result of a stream that takes the table in several micro-batches."""

    def run(spark, sf_dir):
        stream, partitions = _portioned(spark, sf_dir, name)
        return stream_result(lambda _: _naive(CATALOG[name](table(stream), **params)), spark, name, partitions)

    return run


def _rebuild_stream(one_scan):
    def run(spark, sf_dir):
        events = ev.events(spark, sf_dir)

        def build(closing):
            signals = ev.bi_calls(ev.events_stream(spark, sf_dir, closing)).withWatermark("event_time", "10 minutes")
            return _naive(rebuild_spans(signals, "unique_id", ["calling_party"], "4 hours", one_scan=one_scan))

        return stream_result(build, spark, "spans_rebuild", _partitions(spark, events), ev.closing_event(events, False))

    return run


def _upserts_stream(spark, sf_dir):
    """Exact counts in update mode over several micro-batches: the last row of each user and day."""
    stream, partitions = _portioned(spark, sf_dir, "mobility_upserts")
    towers = ev.mono_towers(stream).withWatermark("start_time", "10 minutes")
    rows = mobility_upserts(towers, "unique_id", "tower_id", "start_time", "1 day", 2)
    table = UpsertTable(f"{shared_folder(spark, 'mobility_upserts')}/rows")
    run_to_end(lambda _: rows, spark, shared_folder(spark, "mobility_upserts"), partitions, sink=table, mode="update")
    return _naive(table.folded(spark, ["window_start", "window_end", "unique_id"]))


#: Of the events so many come so many portions after their own, behind the watermark of this delay.
LATE_EVERY, LATE_PORTIONS, LATE_DELAY = 50, 2, "1 hour"


def _late_stream(spark, sf_dir):
    """Events in a fixed order of portions, some long after their time: which were refused, and by which watermark."""
    events = ev.events(spark, sf_dir)
    own = ev.portion_by_time(events, PORTIONS)
    held_up = F.least(F.lit(PORTIONS - 1), own + LATE_PORTIONS)
    stream, partitions = _portioned(spark, sf_dir, "late", F.when(F.col("event_id") % LATE_EVERY == 0, held_up).otherwise(own))
    table = LateTable(f"{shared_folder(spark, 'late')}/table", "ts", LATE_DELAY)
    run_to_end(lambda _: stream.where("event_id >= 0"), spark, shared_folder(spark, "late"), partitions, sink=table)
    return _naive(table.rows(spark).select("event_id", "user_id", F.col("batch").cast("long").alias("batch"), "late", "refused_by"))


def _state_after_close(spark, sf_dir):
    """What the checkpoint of a closed stream still holds of the table's own rows, by operator, next to what came in."""
    events, folder = ev.events(spark, sf_dir), shared_folder(spark, "state")

    def build(closing):
        return _naive(CATALOG["mobility_mono_5m"](ev.mono_towers(ev.events_stream(spark, sf_dir, closing)), window="1 day", threshold=2))

    figures = run_to_end(build, spark, folder, _partitions(spark, events), ev.closing_event(events, True))
    taken = sum(f["input_rows"] for f in figures)
    held = state_rows(spark, f"{folder}/checkpoint", "key.unique_id >= 0")
    return held.select(F.col("operator_id").cast("long").alias("operator_id"), F.col("rows").alias("own_rows"),
                       F.lit(taken - 1).cast("long").alias("input_rows"))


#: Lines of the CSV files that are made unsound, by their event: too short, too long, no number, no time. Lines of a file.
SHORT_EVERY, LONG_EVERY, WORD_EVERY, TIME_EVERY, FILE_LINES = 97, 101, 103, 107, 20_000


def _unsound_towers(spark, sf_dir):
    """Stays as CSV lines, in order of the event within files of ``FILE_LINES`` lines and a header."""
    layout, folder = TABLES["mono_towers"], shared_folder(spark, "unsound")
    event = F.col("event_id")
    stays = ev.with_packed(ev.mono_towers(ev.events(spark, sf_dir), keep=["event_id"]), start_ts="start_time", end_ts="end_time")
    user = F.concat(F.when(event % WORD_EVERY == 0, "u").otherwise(""), F.col("unique_id").cast("string"))
    end = F.when(event % TIME_EVERY == 0, F.lit("20241341000000000")).otherwise(F.col("end_ts").cast("string"))
    cells = F.array(user, F.col("tower_id"), F.col("start_ts").cast("string"), end)
    cells = F.when(event % SHORT_EVERY == 0, F.slice(cells, 1, 2)).when(
        event % LONG_EVERY == 0, F.concat(cells, F.array(F.lit("more")))).otherwise(cells)
    file = F.call_function("div", event, F.lit(FILE_LINES).cast("long")).alias("file")
    lines = stays.select(file, event, F.concat_ws(",", cells).alias("value"))
    headers = lines.select("file").distinct().select(
        "file", F.lit(-1).cast("long").alias("event_id"), F.lit(",".join(h for h, _, _ in layout.fields)).alias("value"))
    ordered = lines.unionByName(headers).repartition("file").sortWithinPartitions("file", "event_id")
    ordered.select("file", "value").write.partitionBy("file").text(folder)
    return read_checked(spark, folder, "mono_towers")


def _sound_rows(spark, sf_dir):
    return _naive(_unsound_towers(spark, sf_dir)[0])


def _quarantine(spark, sf_dir):
    file = F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("file")
    return _unsound_towers(spark, sf_dir)[1].select(file, "line", "record", "fault")


def _rolled_up(window):
    """Sketches of an hour, stored, and merged into longer windows from there."""

    def run(spark, sf_dir):
        folder = shared_folder(spark, "sketches")
        mobility_sketches(_towers(spark, sf_dir), "unique_id", "tower_id", "start_time", "1 hour").write.parquet(folder)
        merged = merge_sketches(spark.read.parquet(folder), "unique_id", window)
        return _naive(sketched_mobility(merged, 2 if window else 9))

    return run


def _mono_packed(spark, sf_dir):
    return ev.with_packed(_calls(spark, sf_dir), start_ts="start_time", end_ts="end_time")


def _bi_packed(spark, sf_dir):
    return ev.with_packed(_call_signals(spark, sf_dir), event_ts="event_time")


def _packed_parse(spark, sf_dir):
    df = _mono_packed(spark, sf_dir)
    return _naive(df.select("unique_id", "start_ts", parse_packed("start_ts").alias("start_time")))


def _packed_bucket(spark, sf_dir):
    return _mono_packed(spark, sf_dir).select(
        "unique_id", "end_ts", packed_bucket("end_ts").alias("bucket"))


def _packed_gap(spark, sf_dir):
    return _mono_packed(spark, sf_dir).select(
        "unique_id", packed_gap("start_ts", "end_ts").alias("gap"))


def _scan(table, make):
    """Write the table as CSV in its file layout to the shared folder, and read that back."""

    def run(spark, sf_dir):
        folder = shared_folder(spark, f"scan_{table}")
        write_spans(make(spark, sf_dir), folder, table)
        return _naive(read_spans(spark, folder, table))

    return run


def _scan_stream(table, make):
    """The same files as a stream, one to a micro-batch."""

    def run(spark, sf_dir):
        folder = shared_folder(spark, f"scan_{table}_stream")
        write_spans(make(spark, sf_dir).repartition(4), folder, table)
        return stream_result(lambda _: _naive(read_spans(spark, folder, table, True, 1)), spark, f"scan_{table}")

    return run


def _malformed_towers(spark, sf_dir):
    """Stays whose end is no packed time at three of the towers: a word, 18 digits, missing."""
    text, tower = F.col("end_ts").cast("string"), F.col("tower_id")
    bad = F.when(tower == "T1", "junk").when(tower == "T2", F.concat(F.lit("0"), text)).when(tower != "T3", text)
    return _full_mono_towers(spark, sf_dir).select("unique_id", "tower_id", bad.alias("end_ts"))


def _malformed_parse(spark, sf_dir):
    df = _malformed_towers(spark, sf_dir)
    return _naive(df.withColumn("end_time", parse_packed("end_ts")))


def _malformed_mobility(spark, sf_dir):
    return mobility_packed(_malformed_towers(spark, sf_dir), "unique_id", "tower_id", "end_ts", DAY_PACKED, 1)


def _views_question(spark, sf_dir):
    """The four tables as files and views: how many stays began during a call of the same user, by tower."""
    folder = shared_folder(spark, "views")
    makers = {"mono_calls": _full_mono_calls, "bi_calls": _full_bi_calls, "mono_towers": _full_mono_towers,
              "bi_towers": _full_bi_towers}
    for table, make in makers.items():
        for _ in range(2):  # the second write replaces the first
            write_spans(make(spark, sf_dir).repartition(2), f"{folder}/{TABLES[table].folder}", table)
    register_tables(spark, folder)
    return spark.sql("""
        SELECT t.tower_id, count(*) AS stays, count(DISTINCT c.unique_id) AS calls
        FROM bi_towers t JOIN mono_calls c ON t.unique_id = c.calling_party
        WHERE t.event_type = 0 AND t.event_time BETWEEN c.start_time AND c.end_time GROUP BY t.tower_id""")


def _full_mono_calls(spark, sf_dir):
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    return _mono_packed(spark, sf_dir).withColumns({
        "called_party": F.col("calling_party") + 1,
        "duration": seconds.cast("int"),
        "imei": F.col("unique_id") + 100_000_000_000_000,
    })


def _full_bi_calls(spark, sf_dir):
    return _bi_packed(spark, sf_dir).withColumns({
        "called_party": F.col("calling_party") + 1,
        "imei": F.col("unique_id") + 100_000_000_000_000,
    })


def _full_mono_towers(spark, sf_dir):
    return ev.with_packed(_towers(spark, sf_dir), start_ts="start_time", end_ts="end_time")


def _full_bi_towers(spark, sf_dir):
    return ev.with_packed(_tower_signals(spark, sf_dir), event_ts="event_time")


def _rebuild(**params):
    return lambda spark, sf_dir: rebuild_spans(_call_signals(spark, sf_dir), "unique_id", **params)


def _hot_id(spark, sf_dir):
    """Signals of calls, a third of them of one id that ends twice."""
    hot = F.col("unique_id") % 3 == 0
    ends_twice = (F.col("event_type") == 0) | ~hot | (F.col("unique_id") < 6)
    return _call_signals(spark, sf_dir).where(ends_twice).withColumn("unique_id", F.when(hot, F.lit(0)).otherwise(F.col("unique_id")))


def _rebuild_hot_id(spark, sf_dir):
    return rebuild_spans(_hot_id(spark, sf_dir), "unique_id", block_rows=500)


def entry(spark: SparkSession) -> DataFrame:
    return queries()["mobility_mono_5m"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per implemented query."""
    return _span_queries() | (corpus.queries() if corpus else {})


def _span_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "mobility_mono_5s_exact": _batch(
            "mobility_mono_5s_exact", _full_mono_towers, width=DAY_PACKED, threshold=2),
        "mobility_mono_5s_approx": _batch(
            "mobility_mono_5s_approx", _towers, window="1 day", threshold=2),
        "mobility_bi_5s_approx": _batch(
            "mobility_bi_5s_approx", _tower_signals, window="1 day", threshold=2),
        "mobility_bi_total": _batch("mobility_bi_total", _tower_signals, threshold=9),
        "mobility_mono_5m": _batch("mobility_mono_5m", _towers, window="1 day", threshold=2),
        "mobility_bi_5m": _batch("mobility_bi_5m", _tower_signals, window="1 day", threshold=2),
        "b2b_mono_packed": _batch("b2b_mono_packed", _mono_packed, max_gap=100_000_000),
        "b2b_bi_packed": _batch("b2b_bi_packed", _bi_packed, max_gap=10_000_000),
        "b2b_mono": _batch("b2b_mono", _calls, max_gap_s=HOUR_S),
        "b2b_mono_ranges": _batch("b2b_mono", _calls, max_gap_s=HOUR_S, one_shuffle=True),
        "b2b_bi": _batch("b2b_bi", _call_signals, bound="4 hours", max_gap_s=6 * HOUR_S),
        "b2b_bi_one_per_id": _batch(
            "b2b_bi", _call_signals, bound="4 hours", max_gap_s=6 * HOUR_S, one_per_id=True),
        "spans_split_calls": _call_signals,
        "spans_split_towers": _tower_signals,
        "spans_rebuild": _rebuild(),
        "spans_rebuild_bounded": _rebuild(keys=["calling_party"], bound="4 minutes"),
        "spans_rebuild_one_per_id": _rebuild(keys=["calling_party"], bound="4 hours", one_per_id=True),
        "spans_rebuild_hot_id": _rebuild_hot_id,
        "packed_parse": _packed_parse,
        "packed_bucket": _packed_bucket,
        "packed_gap": _packed_gap,
        "scan_mono_calls_csv": _scan("mono_calls", _full_mono_calls),
        "scan_bi_calls_csv": _scan("bi_calls", _full_bi_calls),
        "scan_mono_towers_csv": _scan("mono_towers", _full_mono_towers),
        "scan_bi_towers_csv": _scan("bi_towers", _full_bi_towers),
        "scan_mono_towers_csv_stream": _scan_stream("mono_towers", _full_mono_towers),
        "scan_bi_towers_csv_stream": _scan_stream("bi_towers", _full_bi_towers),
        "packed_parse_malformed": _malformed_parse,
        "mobility_packed_malformed": _malformed_mobility,
        "views_question": _views_question,
        # With the customary constants of each query.
        "mobility_mono_5s_exact_default": _batch("mobility_mono_5s_exact", _packed(ev.mono_towers, SECONDS_APART, _MONO)),
        "mobility_mono_5s_approx_default": _batch("mobility_mono_5s_approx", _dense(ev.mono_towers, SECONDS_APART)),
        "mobility_bi_5s_approx_default": _batch("mobility_bi_5s_approx", _dense(ev.bi_towers, SECONDS_APART)),
        "mobility_bi_total_default": _batch("mobility_bi_total", _dense(ev.bi_towers, SECONDS_APART)),
        "mobility_mono_5m_default": _batch("mobility_mono_5m", _dense(ev.mono_towers, MINUTES_APART)),
        "mobility_bi_5m_default": _batch("mobility_bi_5m", _dense(ev.bi_towers, MINUTES_APART)),
        "b2b_mono_packed_default": _batch("b2b_mono_packed", _packed(ev.mono_calls, MINUTES_APART, _MONO)),
        "b2b_bi_packed_default": _batch("b2b_bi_packed", _packed(ev.bi_calls, MINUTES_APART, _BI)),
        "b2b_mono_default": _batch("b2b_mono", _dense(ev.mono_calls, MINUTES_APART)),
        "b2b_bi_default": _batch("b2b_bi", _dense(ev.bi_calls, MINUTES_APART)),
        "mobility_mono_5s_approx_stream": _stream(
            "mobility_mono_5s_approx", ev.mono_towers, ended=True, window="1 day", threshold=2),
        "mobility_bi_5s_approx_stream": _stream(
            "mobility_bi_5s_approx", ev.bi_towers, window="1 day", threshold=2),
        "mobility_mono_5m_stream": _stream("mobility_mono_5m", ev.mono_towers, window="1 day", threshold=2),
        "mobility_bi_5m_stream": _stream("mobility_bi_5m", ev.bi_towers, window="1 day", threshold=2),
        # With the customary constants, on a stream.
        "mobility_mono_5s_approx_default_stream": _stream(
            "mobility_mono_5s_approx", _close_together(ev.mono_towers, SECONDS_APART), ended=True),
        "mobility_bi_5s_approx_default_stream": _stream(
            "mobility_bi_5s_approx", _close_together(ev.bi_towers, SECONDS_APART)),
        "mobility_mono_5m_default_stream": _stream("mobility_mono_5m", _close_together(ev.mono_towers, MINUTES_APART)),
        "mobility_bi_5m_default_stream": _stream("mobility_bi_5m", _close_together(ev.bi_towers, MINUTES_APART)),
        "b2b_mono_default_stream": _stream("b2b_mono", _close_together(ev.mono_calls, MINUTES_APART)),
        "b2b_bi_default_stream": _stream("b2b_bi", _close_together(ev.bi_calls, MINUTES_APART)),
        "spans_rebuild_stream": _rebuild_stream(False),
        "spans_rebuild_one_scan_stream": _rebuild_stream(True),
        # Over several micro-batches.
        "b2b_mono_stream": _portioned_stream("b2b_mono", ev.mono_calls, max_gap_s=HOUR_S, slice_s=DAY_S),
        "b2b_bi_stream": _portioned_stream(
            "b2b_bi", ev.bi_calls, bound="4 hours", max_gap_s=6 * HOUR_S, slice_s=DAY_S),
        "mobility_upserts_stream": _upserts_stream,
        "mobility_resumed_stream": _stream("mobility_mono_5m", ev.mono_towers, resume=True, window="1 day", threshold=2),
        "late_rows_stream": _late_stream,
        "state_after_close": _state_after_close,
        "scan_unsound_rows": _sound_rows,
        "scan_quarantine": _quarantine,
        "mobility_sketch_days": _rolled_up("1 day"),
        "mobility_sketch_total": _rolled_up(None),
    }


# ---------------------------------------------------------------------------------------------
# DuckDB texts
# ---------------------------------------------------------------------------------------------

_DUCK_PACKED = "CAST(strftime({0}, '%Y%m%d%H%M%S%g') AS BIGINT)"

def _views(events: str = "events") -> str:
    return _VIEWS.replace("FROM events", f"FROM {events}")


def _dense_views(factor: int) -> str:
    return _views(f"(SELECT * REPLACE (make_timestamp(epoch_us(ts) // {factor}) AS ts) FROM events)")


_VIEWS = """
WITH mono_calls AS (
  SELECT event_id AS unique_id, user_id AS calling_party, ts AS start_time,
         ts + to_seconds(CAST(floor(value * 20) AS INTEGER) + 1) AS end_time,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'connected' END AS disposition
  FROM events),
bi_calls AS (
  SELECT unique_id, calling_party, disposition, CAST(0 AS INTEGER) AS event_type,
         start_time AS event_time FROM mono_calls
  UNION ALL
  SELECT unique_id, calling_party, disposition, CAST(1 AS INTEGER), end_time FROM mono_calls),
mono_towers AS (
  SELECT user_id AS unique_id,
         'T' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 10 + 1) AS tower_id,
         ts AS start_time,
         ts + to_seconds(CAST(floor(value * 20) AS INTEGER) + 1) AS end_time
  FROM events),
bi_towers AS (
  SELECT unique_id, tower_id, CAST(0 AS INTEGER) AS event_type, start_time AS event_time FROM mono_towers
  UNION ALL
  SELECT unique_id, tower_id, CAST(1 AS INTEGER), end_time FROM mono_towers)
"""


def _windowed(table: str, time: str, where: str = "TRUE", width: str = "1 DAY", least: int = 2,
              views: str = _VIEWS) -> str:
    return views + f"""
SELECT time_bucket(INTERVAL {width}, {time}) AS window_start,
       time_bucket(INTERVAL {width}, {time}) + INTERVAL {width} AS window_end,
       unique_id, count(DISTINCT tower_id) AS distinct_items
FROM {table} WHERE {where} GROUP BY 1, 2, 3 HAVING count(DISTINCT tower_id) > {least}"""


def _mobility_packed(end: str, width: int, views: str = _VIEWS) -> str:
    return views + f"""
SELECT ({end} // {width}) * {width} AS window_start, unique_id, count(DISTINCT tower_id) AS distinct_items
FROM mono_towers GROUP BY 1, 2 HAVING count(DISTINCT tower_id) > 2 ORDER BY 1, 2"""


#: Users with more than so many towers in a bucket of one day: packed time, table, threshold.
_PACKED_DAYS = f"""
SELECT ({{0}} // {DAY_PACKED}) * {DAY_PACKED} AS window_start, unique_id, count(DISTINCT tower_id) AS distinct_items
FROM {{1}} WHERE {{0}} IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT tower_id) > {{2}}"""


def _mobility_total(least: int, views: str = _VIEWS) -> str:
    return views + f"""
SELECT unique_id, count(DISTINCT tower_id) AS distinct_items
FROM bi_towers WHERE event_type = 0 GROUP BY 1 HAVING count(DISTINCT tower_id) > {least}"""


def _follow(spans: str, gap_s: int) -> str:
    return f"""
SELECT calling_party, unique_id, prev_end, start_time,
       date_sub('second', prev_end, start_time) AS gap_s
FROM (SELECT *, lag(end_time) OVER (PARTITION BY calling_party ORDER BY start_time, unique_id) AS prev_end
      FROM {spans})
WHERE start_time >= prev_end AND date_sub('second', prev_end, start_time) <= {gap_s}"""


def _follow_packed(spans: str, gap: int) -> str:
    return f"""
SELECT calling_party, unique_id, prev_end, start_ts, start_ts - prev_end AS gap
FROM (SELECT *, lag(end_ts) OVER (PARTITION BY calling_party ORDER BY start_ts, unique_id) AS prev_end
      FROM {spans})
WHERE start_ts - prev_end > 0 AND start_ts - prev_end <= {gap}"""


def _pairs(bound: str, where: str = "TRUE") -> str:
    return f"""
SELECT s.unique_id, s.calling_party, s.event_time AS start_time, e.event_time AS end_time
FROM (SELECT * FROM bi_calls WHERE {where}) s
JOIN (SELECT * FROM bi_calls WHERE {where}) e
  ON s.unique_id = e.unique_id AND s.calling_party = e.calling_party
 AND e.event_time BETWEEN s.event_time AND s.event_time + INTERVAL {bound}
WHERE s.event_type = 0 AND e.event_type = 1"""


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL, of every query that SQL can express."""
    return _span_texts() | (corpus.oracle_sql() if corpus else {})


def _span_texts() -> dict[str, str]:
    start, end, event = (_DUCK_PACKED.format(c) for c in ("start_time", "end_time", "event_time"))
    enter = "event_type = 0"
    connected = "disposition = 'connected'"
    packed_calls = f"(SELECT calling_party, unique_id, {start} AS start_ts, {end} AS end_ts FROM mono_calls)"
    packed_pairs = f""", packed AS (SELECT *, {event} AS event_ts FROM bi_calls),
packed_pairs AS (
  SELECT s.calling_party, s.unique_id, s.event_ts AS start_ts, e.event_ts AS end_ts
  FROM packed s JOIN packed e ON s.unique_id = e.unique_id WHERE s.event_type = 0 AND e.event_type = 1)"""
    malformed = _VIEWS + f""", malformed AS (
  SELECT unique_id, tower_id, end_time, CASE tower_id WHEN 'T1' THEN 'junk' WHEN 'T2' THEN '0' || CAST({end} AS VARCHAR)
    WHEN 'T3' THEN NULL ELSE CAST({end} AS VARCHAR) END AS end_ts FROM mono_towers)"""
    seconds, minutes = _dense_views(SECONDS_APART), _dense_views(MINUTES_APART)
    five_s, five_m = {"width": "5 SECOND", "views": seconds}, {"width": "5 MINUTE", "least": 5, "views": minutes}
    imei = "unique_id + 100000000000000 AS imei"
    cut = "date_trunc('millisecond', {0}) AS {0}"
    sound = _views("events").replace("SELECT user_id AS unique_id,", "SELECT event_id, user_id AS unique_id,") + f""", faults AS (
  SELECT *, row_number() OVER (PARTITION BY event_id // {FILE_LINES} ORDER BY event_id) + 1 AS line,
         CASE WHEN event_id % {WORD_EVERY} = 0 THEN 'u' ELSE '' END AS u,
         CASE WHEN event_id % {TIME_EVERY} = 0 THEN '20241341000000000' ELSE CAST({end} AS VARCHAR) END AS e,
         CASE WHEN event_id % {SHORT_EVERY} = 0 OR event_id % {LONG_EVERY} = 0 THEN 'cells'
              WHEN event_id % {WORD_EVERY} = 0 THEN 'unique_id' WHEN event_id % {TIME_EVERY} = 0 THEN 'end_ts' END AS fault
  FROM mono_towers)"""
    mono_5m = _windowed("mono_towers", "start_time")
    bi_5m = _windowed("bi_towers", "event_time", enter)
    bounded = _VIEWS + _pairs("4 HOUR")
    b2b_bi = _VIEWS + _follow(f"({_pairs('4 HOUR', connected)})", 6 * HOUR_S)
    scan_mono_towers = _VIEWS + f"""
SELECT unique_id, tower_id, CAST({start} AS VARCHAR) AS start_ts, CAST({end} AS VARCHAR) AS end_ts,
       {cut.format('start_time')}, {cut.format('end_time')}
FROM mono_towers"""
    scan_bi_towers = _VIEWS + f"""
SELECT unique_id, tower_id, event_type, CAST({event} AS VARCHAR) AS event_ts, {cut.format('event_time')}
FROM bi_towers"""
    return {
        "mobility_mono_5s_exact": _mobility_packed(end, DAY_PACKED),
        "mobility_mono_5s_approx": _windowed("mono_towers", "end_time"),
        "mobility_bi_5s_approx": bi_5m,
        "mobility_bi_total": _mobility_total(9),
        "mobility_mono_5m": mono_5m,
        "mobility_bi_5m": bi_5m,
        "b2b_mono_packed": _VIEWS + _follow_packed(packed_calls, 100_000_000),
        "b2b_bi_packed": _VIEWS + packed_pairs + _follow_packed("packed_pairs", 10_000_000),
        "b2b_mono": _VIEWS + _follow("mono_calls", HOUR_S),
        "b2b_mono_ranges": _VIEWS + _follow("mono_calls", HOUR_S),
        "b2b_bi": b2b_bi,
        "b2b_bi_one_per_id": b2b_bi,
        "spans_split_calls": _VIEWS + """
SELECT unique_id, calling_party, disposition, event_type, event_time FROM bi_calls""",
        "spans_split_towers": _VIEWS + """
SELECT unique_id, tower_id, event_type, event_time FROM bi_towers""",
        "spans_rebuild": _VIEWS + """
SELECT s.unique_id, s.event_time AS start_time, e.event_time AS end_time
FROM bi_calls s JOIN bi_calls e ON s.unique_id = e.unique_id
WHERE s.event_type = 0 AND e.event_type = 1""",
        "spans_rebuild_bounded": _VIEWS + _pairs("4 MINUTE"),
        "spans_rebuild_hot_id": _VIEWS + """, hot AS (
  SELECT CASE WHEN unique_id % 3 = 0 THEN 0 ELSE unique_id END AS unique_id, event_type, event_time FROM bi_calls
  WHERE event_type = 0 OR unique_id % 3 <> 0 OR unique_id < 6)
SELECT s.unique_id, s.event_time AS start_time, e.event_time AS end_time
FROM hot s JOIN hot e ON s.unique_id = e.unique_id WHERE s.event_type = 0 AND e.event_type = 1""",
        "spans_rebuild_one_per_id": bounded,
        "packed_parse": _VIEWS + f"""
SELECT unique_id, {start} AS start_ts, {cut.format('start_time')} FROM mono_calls""",
        "packed_bucket": _VIEWS + f"""
SELECT unique_id, {end} AS end_ts, ({end} // 5000) * 5000 AS bucket FROM mono_calls""",
        "packed_gap": _VIEWS + f"""
SELECT unique_id, {end} - {start} AS gap FROM mono_calls""",
        "scan_mono_calls_csv": _VIEWS + f"""
SELECT unique_id, calling_party, calling_party + 1 AS called_party,
       CAST({start} AS VARCHAR) AS start_ts, CAST({end} AS VARCHAR) AS end_ts,
       CAST(date_sub('second', start_time, end_time) AS INTEGER) AS duration, disposition, {imei},
       {cut.format('start_time')}, {cut.format('end_time')}
FROM mono_calls""",
        "scan_bi_calls_csv": _VIEWS + f"""
SELECT unique_id, event_type, calling_party, calling_party + 1 AS called_party,
       CAST({event} AS VARCHAR) AS event_ts, disposition, {imei}, {cut.format('event_time')}
FROM bi_calls""",
        "scan_mono_towers_csv": scan_mono_towers,
        "scan_bi_towers_csv": scan_bi_towers,
        "scan_mono_towers_csv_stream": scan_mono_towers,
        "scan_bi_towers_csv_stream": scan_bi_towers,
        "packed_parse_malformed": malformed + """
SELECT unique_id, tower_id, end_ts, CASE WHEN tower_id NOT IN ('T1', 'T2', 'T3')
  THEN date_trunc('millisecond', end_time) END AS end_time FROM malformed""",
        "mobility_packed_malformed": malformed + _PACKED_DAYS.format("TRY_CAST(end_ts AS BIGINT)", "malformed", 1),
        "views_question": _VIEWS + """
SELECT t.tower_id, count(*) AS stays, count(DISTINCT c.unique_id) AS calls
FROM bi_towers t JOIN mono_calls c ON t.unique_id = c.calling_party
WHERE t.event_type = 0 AND date_trunc('millisecond', t.event_time)
  BETWEEN date_trunc('millisecond', c.start_time) AND date_trunc('millisecond', c.end_time) GROUP BY t.tower_id""",
        "mobility_mono_5s_exact_default": _mobility_packed(end, 5000, seconds),
        "mobility_mono_5s_approx_default": _windowed("mono_towers", "end_time", **five_s),
        "mobility_bi_5s_approx_default": _windowed("bi_towers", "event_time", enter, **five_s),
        "mobility_bi_total_default": _mobility_total(5, seconds),
        "mobility_mono_5m_default": _windowed("mono_towers", "start_time", **five_m),
        "mobility_bi_5m_default": _windowed("bi_towers", "event_time", enter, **five_m),
        "b2b_mono_packed_default": minutes + _follow_packed(packed_calls, 10_000),
        "b2b_bi_packed_default": minutes + packed_pairs + _follow_packed("packed_pairs", 10_000),
        "b2b_mono_default": minutes + _follow("mono_calls", 10),
        "b2b_bi_default": minutes + _follow(f"({_pairs('4 MINUTE', connected)})", 10),
        # A closed stream gives what its batch twin gives.
        "mobility_mono_5s_approx_default_stream": _windowed("mono_towers", "end_time", **five_s),
        "mobility_bi_5s_approx_default_stream": _windowed("bi_towers", "event_time", enter, **five_s),
        "mobility_mono_5m_default_stream": _windowed("mono_towers", "start_time", **five_m),
        "mobility_bi_5m_default_stream": _windowed("bi_towers", "event_time", enter, **five_m),
        "b2b_mono_default_stream": minutes + _follow("mono_calls", 10),
        "b2b_bi_default_stream": minutes + _follow(f"({_pairs('4 MINUTE', connected)})", 10),
        "mobility_mono_5s_approx_stream": _windowed("mono_towers", "end_time"),
        "mobility_bi_5s_approx_stream": bi_5m,
        "mobility_mono_5m_stream": mono_5m,
        "mobility_bi_5m_stream": bi_5m,
        "spans_rebuild_stream": bounded,
        "spans_rebuild_one_scan_stream": bounded,
        "mobility_upserts_stream": mono_5m,
        "mobility_resumed_stream": mono_5m,
        "late_rows_stream": f"""
WITH bounds AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) + 1 AS span FROM events),
placed AS (SELECT *, CAST((epoch_us(ts) - a) * {PORTIONS} // span AS BIGINT) AS own FROM events, bounds),
batched AS (SELECT *, CASE WHEN event_id % {LATE_EVERY} = 0 THEN least({PORTIONS - 1}, own + {LATE_PORTIONS}) ELSE own END AS batch
            FROM placed),
newest AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                         - INTERVAL {LATE_DELAY} AS watermark FROM batched GROUP BY batch)
SELECT event_id, user_id, batch, coalesce(ts <= watermark, FALSE) AS late,
       CASE WHEN ts <= watermark THEN watermark END AS refused_by
FROM batched JOIN newest USING (batch)""",
        "state_after_close": """
SELECT CAST(o AS BIGINT) AS operator_id, CAST(0 AS BIGINT) AS own_rows, (SELECT count(*) FROM events) AS input_rows
FROM range(0, 2) AS operators(o)""",
        "scan_unsound_rows": sound + f"""
SELECT unique_id, tower_id, CAST({start} AS VARCHAR) AS start_ts, CAST({end} AS VARCHAR) AS end_ts,
       {cut.format('start_time')}, {cut.format('end_time')} FROM faults WHERE fault IS NULL""",
        "scan_quarantine": sound + f"""
SELECT event_id // {FILE_LINES} AS file, line, fault, CASE
    WHEN event_id % {SHORT_EVERY} = 0 THEN u || unique_id || ',' || tower_id
    ELSE u || unique_id || ',' || tower_id || ',' || CAST({start} AS VARCHAR) || ',' || e
      || CASE WHEN event_id % {LONG_EVERY} = 0 THEN ',more' ELSE '' END END AS record
FROM faults WHERE fault IS NOT NULL""",
        "mobility_sketch_days": _VIEWS + """
SELECT time_bucket(INTERVAL 1 DAY, start_time) AS window_start, unique_id, count(DISTINCT tower_id) AS distinct_items
FROM mono_towers GROUP BY 1, 2 HAVING count(DISTINCT tower_id) > 2""",
        "mobility_sketch_total": _VIEWS + """
SELECT unique_id, count(DISTINCT tower_id) AS distinct_items
FROM mono_towers GROUP BY 1 HAVING count(DISTINCT tower_id) > 9""",
        "b2b_mono_stream": _VIEWS + _follow("mono_calls", HOUR_S),
        "b2b_bi_stream": b2b_bi,
    }
