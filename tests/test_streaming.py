from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanwise import streaming
from spanwise.operators import mobility, rebuild_spans
from spanwise.plans import CATALOG
from spanwise.streaming import back_to_back_stream, progress, run_stream, shared_folder
from tests.helpers import at, bag, brute_back_to_back, frame

CALL = ("calling_party", "start_time", "end_time", "unique_id")
EVIDENCE = ("calling_party", "unique_id", "prev_end", "start_time")
SCHEMA = "unique_id long, calling_party long, start_time timestamp, end_time timestamp"
MARK = (10**6, -1, 10**7, 10**7)  # a far later row of nobody else, which moves the watermark


class Feed:
    """A folder that receives one Parquet file per batch of rows."""

    def __init__(self, spark, folder, schema=SCHEMA):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir()

    def add(self, rows):
        stage = self.folder.parent / f"stage_{self.n}"
        timed = [tuple(at(v) if k.endswith("time") and v is not None else v
                       for k, v in zip(self._names(), r)) for r in rows]
        frame(self.spark, timed, self.schema).coalesce(1).write.parquet(str(stage))
        (part,) = stage.glob("*.parquet")
        part.rename(self.folder / f"{self.n:04d}.parquet")
        self.n += 1

    def _names(self):
        return [c.split()[0] for c in self.schema.split(", ")]

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in")


def finish(df, tmp_path, tag="", **options):
    """Run over what is there; returns (rows emitted so far, figures)."""
    query = run_stream(df, str(tmp_path / f"out{tag}"), str(tmp_path / f"chk{tag}"), trigger=None, partitions=2,
                       **options)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / f"out{tag}")), progress(query)


def sequential(df, **params):
    return back_to_back_stream(df.withWatermark("start_time", "5 minutes"), *CALL, **params)


def test_pairs_over_files_in_and_out_of_order(spark, feed, tmp_path):
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 6), s, s + rng.choice([0, 1, 5, 40, 400]))
            for i, s in enumerate(sorted(rng.randrange(0, 12000) / 4 for _ in range(400)))]
    # Shuffled within four minutes, below the five of the watermark.
    jittered = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 240))
    for k in range(0, len(jittered), 100):
        feed.add(jittered[k:k + 100])
    feed.add([MARK])
    got, figures = finish(sequential(feed.stream(), slice_s=30, lanes=3), tmp_path)
    assert bag(got, *EVIDENCE) == brute_back_to_back(rows)
    assert sum(f["late_rows"] for f in figures) == 0
    assert len(figures) >= feed.n


def test_long_call_keeps_waiting_for_its_follower(spark, feed, tmp_path):
    # Call 1 ends far beyond the watermark of the batches in between; call 2 of another
    # caller moves the watermark on. Call 4 touches call 1, call 5 comes too late after 4.
    feed.add([(1, 7, 0, 5000)])
    feed.add([(3, 8, 4000, 4001)])
    feed.add([(4, 7, 5000, 5005), (6, 7, 5020, 5021)])
    feed.add([MARK])
    got, _ = finish(sequential(feed.stream(), slice_s=60), tmp_path)
    assert bag(got, *EVIDENCE) == {(7, 4, at(5000), at(5000)): 1}


def test_missing_values_and_rule_options(spark, feed, tmp_path):
    rows = [(1, 7, 0, 10), (2, 7, 10, None), (3, 7, 12, 14), (4, None, 0, 3), (5, None, 3, 4), (6, None, 5, 6),
            (7, 9, 0, 1), (8, 9, 11.999999, 12), (9, 9, 23, 24)]
    # Copies, alone in their slice or not, after a row of the slice before.
    rows += [(20, 3, 94, 95), *[(21, 3, 100, 100)] * 3, (22, 3, 104, 104), (22, 3, 104, 104), (23, 3, 104.5, 105)]
    feed.add([*rows, (10, 7, None, 3), MARK])
    got, _ = finish(sequential(feed.stream(), slice_s=5), tmp_path, "a")
    assert bag(got, *EVIDENCE) == brute_back_to_back(rows)
    # The session's time zone does not matter.
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        strict, _ = finish(sequential(feed.stream(), allow_zero=False, slice_s=60), tmp_path, "b")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert bag(strict, *EVIDENCE) == brute_back_to_back(rows, allow_zero=False)


def test_late_row_is_dropped(spark, feed, tmp_path):
    feed.add([(1, 7, 0, 10), (2, 8, 1000, 1001)])
    feed.add([(9, 8, 2000, 2001)])
    feed.add([(3, 7, 12, 20), (4, 7, 1900, 1901)])
    feed.add([MARK])
    got, figures = finish(sequential(feed.stream()), tmp_path)
    assert got.count() == 0
    assert sum(f["late_rows"] for f in figures) == 1


def test_restart_resumes_from_the_checkpoint(spark, feed, tmp_path):
    first = [(1, 7, 0, 100), (2, 8, 0, 990)]
    second = [(3, 7, 105, 150), (4, 8, 991, 1000)]
    feed.add(first)
    got, _ = finish(sequential(feed.stream(), slice_s=30, lanes=2), tmp_path)
    assert got.count() == 0
    feed.add(second)
    finish(sequential(feed.stream(), slice_s=30, lanes=2), tmp_path)
    feed.add([MARK])
    got, figures = finish(sequential(feed.stream(), slice_s=30, lanes=2), tmp_path)
    assert bag(got, *EVIDENCE) == brute_back_to_back(first + second)
    assert sum(f["input_rows"] for f in figures) == 1


def test_restart_under_other_shuffle_partitions_loses_no_pair(spark, feed, tmp_path):
    first = [(i, i, 0, 100) for i in range(50)]
    second = [(100 + i, i, 105, 110) for i in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, rows in (("4", first), ("6", second), ("3", [MARK])):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            feed.add(rows)
            got, _ = finish(sequential(feed.stream(), slice_s=30), tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert bag(got, *EVIDENCE) == brute_back_to_back(first + second) and got.count() == 50


@pytest.mark.parametrize("slice_s", [7, 600, 86_400])
def test_a_closed_stream_gives_all_pairs_whatever_its_slices(spark, tmp_path, slice_s):
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), s := rng.randrange(0, 9000), s + rng.choice([1, 5, 90])) for i in range(300)]
    table = Feed(spark, tmp_path / "table")
    table.add(rows)
    last = frame(spark, [(-1, -1, at(10**8), None)], SCHEMA)

    def build(closing):
        both = [spark.readStream.schema(SCHEMA).parquet(p) for p in (str(table.folder), closing)]
        return sequential(both[0].unionByName(both[1]), slice_s=slice_s)

    got = streaming.stream_result(build, spark, partitions=2, closing=last)
    assert bag(got, *EVIDENCE) == brute_back_to_back(rows)


def test_several_keys_and_text_columns(spark, tmp_path):
    schema = "unique id string, area string, _caller long, start_time timestamp, end_time timestamp"
    feed = Feed(spark, tmp_path / "in", schema.replace("unique id", "uid"))
    big = 2**60 + 1  # not a whole number any more once it has been a float
    feed.add([("a", "x", big, 0, 5), ("b", "x", big, 6, 7), ("c", "y", 1, 8, 9), ("d", None, big, 9, 9),
              ("e", None, big, 9, 9), ("f", "x", None, 8, 9), ("g", "x", None, 9, 9), ("h", "x", big + 1, 8, 9),
              ("z", "z", 0, 10**7, 10**7)])
    df = feed.stream().withWatermark("start_time", "1 second").withColumnRenamed("uid", "unique id")
    got, _ = finish(back_to_back_stream(df, ["area", "_caller"], "start_time", "end_time", "unique id"), tmp_path)
    assert got.columns == ["area", "_caller", "unique id", "prev_end", "start_time", "gap_s"]
    assert bag(got, "area", "_caller", "unique id") == {
        ("x", big, "b"): 1, (None, big, "e"): 1, ("x", None, "g"): 1}


def test_state_is_let_go(spark, feed, tmp_path):
    for k in range(3):
        feed.add([(100 * k + i, i, 1000 * k + i, 1000 * k + i + 1) for i in range(50)])
    feed.add([MARK])
    _, figures = finish(sequential(feed.stream(), slice_s=60, lanes=3), tmp_path)
    # What is left is the slice of the mark and its lane's figures; before, one row per key of the two slices that are open.
    assert figures[-1]["state_rows"] <= 12
    assert max(f["state_rows"] for f in figures) <= 110


# -- rebuilt spans ---------------------------------------------------------------------------

SIGNALS = "unique_id long, event_type int, calling_party long, event_time timestamp, disposition string"


def signal_rows(seed=11, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start, caller = rng.randrange(0, 20000) / 4, rng.randrange(6)
        length = rng.choice([0, 2, 20, 239, 241])
        d = "failed" if rng.random() < 0.1 else "connected"
        rows += [(i, 0, caller, start, d), (i, 1, caller, start + length, d)]
    return sorted(rows, key=lambda r: r[3])


def test_rebuild_and_chain(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SIGNALS)
    rows = signal_rows()
    for k in range(0, len(rows), 100):
        feed.add(rows[k:k + 100])
    feed.add([(10**6, 0, -1, 10**7, "connected"), (10**6, 1, -1, 10**7, "connected")])
    batch = spark.read.schema(SIGNALS).parquet(str(tmp_path / "in"))
    df = feed.stream().withWatermark("event_time", "10 minutes")
    got, figures = finish(rebuild_spans(df, "unique_id", ["calling_party"], "4 minutes"), tmp_path, "a")
    # Watermark and bound let the signals go: only the last two, and their counters, are left.
    assert figures[-1]["state_rows"] <= 8 < max(f["state_rows"] for f in figures)
    want = rebuild_spans(batch, "unique_id", ["calling_party"], "4 minutes")
    assert bag(got) == bag(want) and want.count() > 80

    chained, _ = finish(CATALOG["b2b_bi"](feed.stream(), max_gap_s=90, slice_s=60), tmp_path, "b")
    want = CATALOG["b2b_bi"](batch, max_gap_s=90)
    assert bag(chained) == bag(want) and want.count() > 10


def test_stream_needs_a_bound(spark, tmp_path):
    df = Feed(spark, tmp_path / "in", SIGNALS).stream().withWatermark("event_time", "1 minute")
    with pytest.raises(ValueError, match="bound"):
        rebuild_spans(df, "unique_id")


# -- mobility --------------------------------------------------------------------------------

STAYS = "unique_id long, tower_id string, start_time timestamp, end_time timestamp"


def stay_feed(spark, tmp_path):
    rng = random.Random(5)
    feed = Feed(spark, tmp_path / "in", STAYS)
    rows = sorted((rng.randrange(5), f"T{rng.randrange(10)}", s, s + 3) for s in
                  (rng.randrange(0, 1200) for _ in range(300)))
    rows.sort(key=lambda r: r[2])
    for k in range(0, 300, 100):
        feed.add(rows[k:k + 100])
    feed.add([(99, "T1", 10**6, 10**6)])
    return feed, spark.read.schema(STAYS).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("approx", [False, True])
def test_mobility_equals_batch(spark, tmp_path, approx):
    feed, batch = stay_feed(spark, tmp_path)
    args = ("unique_id", "tower_id", "start_time", "1 minute", 2)
    df = feed.stream().withWatermark("start_time", "10 seconds")
    got, _ = finish(mobility(df, *args, approx=approx), tmp_path)
    want = mobility(batch, *args)
    assert got.columns == want.columns
    assert bag(got) == bag(want) and want.count() > 20


def test_update_mode_to_memory_and_console(spark, tmp_path):
    feed, batch = stay_feed(spark, tmp_path)
    df = CATALOG["mobility_mono_5s_approx"](feed.stream(), window="1 minute")
    query = run_stream(df, "memory", mode="update", trigger=None, name="towers_seen", partitions=2)
    query.awaitTermination()
    latest = spark.table("towers_seen").groupBy("window_start", "unique_id").agg(F.max("distinct_items").alias("n"))
    want = CATALOG["mobility_mono_5s_approx"](batch, window="1 minute")
    assert bag(latest) == bag(want, "window_start", "unique_id", "distinct_items")
    with pytest.raises(Exception, match="(?i)multiple stateful|update"):
        run_stream(CATALOG["mobility_mono_5m"](feed.stream()), "noop", mode="update", trigger=None)
    total = mobility(feed.stream(), "unique_id", "tower_id", window=None, threshold=5, approx=True)
    run_stream(total, "console", mode="update", trigger=None, partitions=1).awaitTermination()
    with pytest.raises(ValueError, match="approx"):
        mobility(feed.stream(), "unique_id", "tower_id", window=None)


def test_interval_trigger_function_sink_and_monitor(spark, tmp_path):
    feed, batch = stay_feed(spark, tmp_path)
    seen, figures = [], []
    monitor = streaming.Monitor(figures.append)
    spark.streams.addListener(monitor)
    df = CATALOG["mobility_mono_5m"](feed.stream(), window="1 minute", threshold=2)
    query = run_stream(df, lambda part, n: seen.extend(part.collect()), str(tmp_path / "chk"), trigger="100 milliseconds",
                       partitions=2)
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(10)
    spark.streams.removeListener(monitor)
    want = CATALOG["mobility_mono_5m"](batch, window="1 minute", threshold=2)
    assert len(seen) == want.count() > 0
    rows = progress(query)
    assert sum(r["input_rows"] for r in rows) == 301
    assert set(figures[0]) == set(rows[0]) and sum(f["input_rows"] for f in figures) == 301
    assert {"batch_id", "input_rows", "rows_per_second", "latency_ms", "watermark"} <= set(rows[0])


# -- shared folders --------------------------------------------------------------------------


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one.startswith(base) and one != two


def test_settings_are_put_back(spark, tmp_path):
    feed, _ = stay_feed(spark, tmp_path)
    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    before = [spark.conf.get(n) for n in names]
    run_stream(CATALOG["mobility_mono_5m"](feed.stream()), "noop", trigger=None, partitions=2).awaitTermination()
    assert [spark.conf.get(n) for n in names] == before
