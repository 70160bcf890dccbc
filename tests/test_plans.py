"""The named queries with their default constants, on small files in the generator's layout."""

from __future__ import annotations

from datetime import datetime

import pytest

from spanwise import jobs
from spanwise.plans import CATALOG
from spanwise.sources import read_spans
from tests.helpers import at, bag, signals
from tests.test_sources import base  # noqa: F401 (fixture)

FOLDERS = {"mono_calls": "mono_signal_calls", "bi_calls": "bi_signal_calls",
           "mono_towers": "mono_signal_towers", "bi_towers": "bi_signal_towers"}
TEN = datetime(2025, 12, 1, 9, 59, 50)


def run(spark, base, name, **params):  # noqa: F811
    table = CATALOG[name].table
    return CATALOG[name](read_spans(spark, str(base / FOLDERS[table]), table), **params)


def test_mobility_defaults(spark, base):  # noqa: F811
    exact = run(spark, base, "mobility_mono_5s_exact")
    assert bag(exact) == {(20251201095950000, 1, 5): 1, (20251201095955000, 1, 3): 1}
    for name in ("mobility_mono_5s_approx", "mobility_bi_5s_approx"):
        got = {(r.window_start.second, r.distinct_items) for r in run(spark, base, name).collect()}
        assert got == {(50, 5), (55, 3)}
    for name in ("mobility_mono_5m", "mobility_bi_5m"):
        rows = run(spark, base, name).collect()
        assert [(r.window_start, r.window_end, r.distinct_items) for r in rows] == [
            (datetime(2025, 12, 1, 9, 55), datetime(2025, 12, 1, 10, 0), 8)]
    assert bag(run(spark, base, "mobility_bi_total")) == {(1, 8): 1}
    assert run(spark, base, "mobility_bi_total", threshold=8).count() == 0


def test_back_to_back_defaults(spark, base):  # noqa: F811
    # 09:59:57 to 10:00:02 is five seconds, but 4045000 in packed digits.
    assert run(spark, base, "b2b_mono_packed").count() == 0
    for name in ("b2b_mono", "b2b_batch"):
        assert [(r.unique_id, r.gap_s) for r in run(spark, base, name).collect()] == [(2, 5)]
    for once in (False, True):
        packed = run(spark, base, "b2b_bi_packed", one_per_id=once).collect()
        assert [(r.unique_id, r.gap) for r in packed] == [(2, 2000)]
        true = run(spark, base, "b2b_bi", one_per_id=once).collect()
        assert [(r.unique_id, r.gap_s) for r in true] == [(2, 2)]


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("slice_s", [3600, 50])
def test_filters_decide_which_call_is_before(spark, once, slice_s):
    ok, bad = "connected", "failed"
    rows = []
    for i, start, end, d in ((1, 0, 100, ok), (2, 50, 300, bad), (3, 60, 301.5, ok), (4, 105, 110, ok)):
        rows += [(i, 0, 7, start, d), (i, 1, 7, end, d)]
    df = signals(spark, rows)
    # Call 2 failed and call 3 lasts over four minutes: neither is before call 4.
    got = CATALOG["b2b_bi"](df, one_per_id=once, slice_s=slice_s)
    assert bag(got, "unique_id", "prev_end") == {(4, at(100)): 1}
    assert CATALOG["b2b_bi"](df, bound="5 minutes", one_per_id=once, slice_s=slice_s).count() == 0


def test_one_per_id_reads_its_source_once(spark):
    df = signals(spark, [(1, 0, 7, 0, "connected"), (1, 1, 7, 5, "connected")]).repartition(3)
    plan = CATALOG["b2b_bi"](df, one_per_id=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 3 and plan.count("Join") == 0  # of the pairing, the slices, their edges


def test_batch_job(spark, base, tmp_path, capsys):  # noqa: F811
    jobs.main(["b2b_mono", str(base / "mono_signal_calls")])
    out = capsys.readouterr().out
    assert "9000000001" in out and "runtime:" in out and "more rows" not in out
    jobs.main(["mobility_bi_total", str(base / "bi_signal_towers"), "--set", "threshold=1", "--rows", "0"])
    assert "more rows follow; --rows 0 ends here" in capsys.readouterr().out
    jobs.main(["mobility_bi_total", str(base / "bi_signal_towers"), "--sink", str(tmp_path / "o"),
               "--set", "threshold=3"])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_stream_job(spark, base, tmp_path, capsys):  # noqa: F811
    late = "Unique ID,Tower,Event Type,Timestamp\n5,T1,0,20251201120000000\n"
    (base / "bi_signal_towers" / "part_2.csv").write_text(late)
    jobs.main(["mobility_bi_5s_approx", str(base / "bi_signal_towers"), "--stream", "--trigger", "once",
               "--sink", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c")])
    assert "runtime of all micro-batches" in capsys.readouterr().out
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert {(r.window_start.second, r.distinct_items) for r in got} == {(50, 5), (55, 3)}


def test_packed_queries_have_no_streaming_form(spark, base):  # noqa: F811
    df = read_spans(spark, str(base / "mono_signal_calls"), "mono_calls", streaming=True)
    with pytest.raises(ValueError, match="no streaming form"):
        CATALOG["b2b_mono_packed"](df)
