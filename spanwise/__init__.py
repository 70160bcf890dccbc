"""Analytics of spanning events on Spark, in batch and streaming form."""

from spanwise.operators import (
    back_to_back,
    back_to_back_packed,
    mobility,
    mobility_packed,
    rebuild_spans,
    split_spans,
)
from spanwise.sources import TABLES, read_spans, register_tables, write_spans
from spanwise.streaming import back_to_back_stream, progress, run_stream

__all__ = [
    "TABLES",
    "back_to_back",
    "back_to_back_packed",
    "back_to_back_stream",
    "mobility",
    "mobility_packed",
    "progress",
    "read_spans",
    "rebuild_spans",
    "register_tables",
    "run_stream",
    "split_spans",
    "write_spans",
]
