from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanwise.sources import TABLES, read_checked, read_spans, register_tables, write_spans
from spanwise.sources import events as ev
from tests.helpers import bag

MONO_CALLS = """Unique ID,Calling Party,Called Party,Start Time,End Time,Duration (sec),Disposition,IMEI
1, 9000000001, 9000500000, 20251201095950000, 20251201095957000, 7, connected, 123456789012345
2, 9000000001, 9000500001, 20251201100002000, 20251201100009000, 7, connected, 123456789012345
3, 9000000001, 9000500001, 20251132100002000, junk, x, busy, 123456789012345
4, 9000000002
"""
BI_CALLS = """Unique ID,Event Type,Calling Party,Called Party,Timestamp,Disposition,IMEI
1,0,9000000001,9000500000,20251201095950000,connected,123456789012345
1,1,9000000001,9000500000,20251201095957000,connected,123456789012345
2,0,9000000001,9000500001,20251201095959000,connected,123456789012345
2,1,9000000001,9000500001,20251201095959500,connected,123456789012345
"""
MONO_TOWERS = "Unique ID,Tower,Start Timestamp,End Timestamp\n" + "".join(
    f"1,T{n},2025120109595{n}000,2025120109595{n}500\n" for n in range(8))
BI_TOWERS = "Unique ID,Tower,Event Type,Timestamp\n" + "".join(
    f"1,T{n},0,2025120109595{n}000\n1,T{n},1,2025120109595{n}500\n" for n in range(8))


@pytest.fixture
def base(tmp_path):
    texts = {"mono_calls": MONO_CALLS, "bi_calls": BI_CALLS, "mono_towers": MONO_TOWERS, "bi_towers": BI_TOWERS}
    for name, text in texts.items():
        folder = tmp_path / TABLES[name].folder
        folder.mkdir()
        (folder / "part_1.csv").write_text(text)
    return tmp_path


def test_blanks_bad_fields_and_short_rows(spark, base):
    rows = read_spans(spark, str(base / "mono_signal_calls"), "mono_calls").orderBy("unique_id").collect()
    assert [r.calling_party for r in rows] == [9000000001, 9000000001, 9000000001, 9000000002]
    assert rows[0].disposition == "connected" and rows[0].imei == 123456789012345
    assert rows[0].end_time == datetime(2025, 12, 1, 9, 59, 57)
    assert rows[2].start_time is None and rows[2].end_time is None and rows[2].duration is None
    assert rows[3].start_ts is None and rows[3].start_time is None


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Unique ID,Event Type,Tower,Timestamp\n1,0,T1,20251201095950000\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_spans(spark, str(tmp_path), "bi_towers").collect()


def test_merged_file_without_headers(spark, tmp_path):
    lines = [x for x in BI_TOWERS.splitlines(True) if not x.startswith("Unique")]
    (tmp_path / "merged.csv").write_text("".join(lines))
    df = read_spans(spark, str(tmp_path / "merged.csv"), "bi_towers", header=False)
    assert df.count() == 16 and df.where("event_time is null").count() == 0


def test_folder_of_files_drops_every_header(spark, base):
    folder = base / TABLES["bi_calls"].folder
    (folder / "part_2.csv").write_text(BI_CALLS.replace("\n1,", "\n11,").replace("\n2,", "\n12,"))
    df = read_spans(spark, str(folder), "bi_calls")
    assert sorted(r.unique_id for r in df.where("event_type = 0").collect()) == [1, 2, 11, 12]


def test_write_and_read_back_in_both_formats(spark, base, tmp_path):
    for name, layout in TABLES.items():
        df = read_spans(spark, str(base / layout.folder), name)
        for fmt in ("csv", "parquet"):
            out = str(tmp_path / f"{name}_{fmt}")
            write_spans(df, out, name, fmt)
            write_spans(df, out, name, fmt)
            assert bag(read_spans(spark, out, name, fmt=fmt)) == bag(df)


def test_time_of_ingestion_is_optional(spark, base):
    df = read_spans(spark, str(base / "mono_signal_towers"), "mono_towers", ingestion_time=True)
    assert df.where("ingestion_time > start_time").count() == 8


def test_views_stand_for_their_folders_and_are_replaced(spark, base, tmp_path):
    register_tables(spark, str(base))
    for name, layout in TABLES.items():
        view, files = spark.table(name), read_spans(spark, str(base / layout.folder), name)
        assert view.schema == files.schema and bag(view) == bag(files)
        assert [f.name for f in view.schema.fields if f.dataType.typeName() == "timestamp"] == [t for _, t in layout.times]
    # Visits of at least half a second that a call of the same unique id overlaps.
    overlaps = "SELECT count(*) FROM mono_towers t JOIN mono_calls c USING (unique_id) WHERE t.start_time < c.end_time AND c.start_time < t.end_time"
    assert spark.sql(overlaps).first()[0] == 7

    other = tmp_path / "other"
    for name, layout in TABLES.items():
        write_spans(spark.table(name).limit(1), str(other / layout.folder), name)
    register_tables(spark, str(other))
    assert [spark.table(name).count() for name in TABLES] == [1, 1, 1, 1]


def test_unsound_lines_go_to_the_quarantine(spark, tmp_path):
    lines = ["Unique ID,Tower,Start Timestamp,End Timestamp", "1,T1,20251201095950000,20251201095957000", "2,T1,20251201095950000",
             "", "3,T1,20251201095950000,20251201095957000,x", "x4,T1,20251201095950000,20251201095957000",
             "5,T1,20251301095950000,20251201095957000", "Unique ID,Tower,Start Timestamp,End Timestamp",
             '6,"a, b", 20251201095950000 ,20251201095957000', "7,,,", "8,T1,20251201095950000,junk"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("Tower,Unique ID\nT1,9\n")
    rows, bad = read_checked(spark, str(tmp_path), "mono_towers")
    assert rows.columns == read_spans(spark, str(tmp_path / "a.csv"), "mono_towers").columns
    assert sorted((r.unique_id, r.tower_id, r.start_time is None) for r in rows.collect()) == [
        (1, "T1", False), (6, "a, b", False), (7, None, True)]
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.fault) for r in bad.collect())
    assert got == [("a.csv", 3, "cells"), ("a.csv", 5, "cells"), ("a.csv", 6, "unique_id"), ("a.csv", 7, "start_ts"),
                   ("a.csv", 11, "end_ts"), ("b.csv", 1, "cells"), ("b.csv", 2, "cells")]
    assert {r.record for r in bad.collect()} >= {lines[2], lines[4]}


def test_line_numbers_across_blocks(spark, tmp_path):
    good = "1,T1,20251201095950000,20251201095957000"
    (tmp_path / "a.csv").write_text("\n".join(f"bad{n}" if n % 100 == 7 else good for n in range(1, 5001)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows, bad = read_checked(spark, str(tmp_path), "mono_towers")
        assert rows.rdd.getNumPartitions() > 5
        assert sorted((r.line, r.record) for r in bad.collect()) == [(n, f"bad{n}") for n in range(7, 5001, 100)]
        assert rows.count() == 4950
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_every_portion_has_as_many_files(spark, tmp_path):
    """Also one with fewer rows than files: a stream that takes so many files at a time would mix portions."""
    folder, rows = str(tmp_path / "in"), spark.range(100)
    portion = F.when(F.col("id") < 97, 0).when(F.col("id") < 99, 1).otherwise(3)
    files = ev.portions(rows, folder, portion, 4, rows_per_file=5)
    assert files == 5
    written = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(written) == 20
    ids = [{r.id for r in spark.read.schema("id long").parquet(*map(str, written[5 * k:5 * k + 5])).collect()} for k in range(4)]
    assert ids == [set(range(97)), {97, 98}, set(), {99}]


def test_a_large_portion_is_dealt_to_tasks(spark, tmp_path):
    assert ev.portions(spark.range(1_600_001), str(tmp_path / "in"), F.lit(0), 2) == 5
