"""What the operators share: sizes of sent frames, names, tables that are stored and removed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from spanwise.llm import common


def is_sent(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_frames_are_sent_by_rows_and_bytes(spark):
    few = common.stored(spark.range(10).select("id", F.lit("x" * 100).alias("text"), F.array(F.lit(1)).alias("list")), "few")
    assert is_sent(common.small(few)) and not is_sent(common.small(few, rows=9)) and not is_sent(common.small(few, size=1000))
    assert is_sent(common.small(few.limit(0), rows=0, size=0))


def test_own_names_clash_with_none():
    assert common.own_name("doc", ["text"]) == "doc" and common.own_name("doc", ["DOC", "doc_"]) == "doc__"


def test_stored_tables_stay_until_they_are_discarded(spark):
    table = common.stored(spark.range(3), "kept")
    path = Path(table._stored_at.removeprefix("file:"))
    assert table.count() == 3 and path.exists() and str(path).startswith(spark.conf.get("spark.checkpoint.dir"))
    common.discard(table)
    assert not path.exists()
