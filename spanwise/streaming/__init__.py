"""Streaming operators that have no built-in form, and running and watching streams."""

from spanwise.streaming.run import Monitor, progress, run_stream, run_to_end, shared_folder, stream_result
from spanwise.streaming.sessions import back_to_back_stream
from spanwise.streaming.sinks import LateTable, ProgressTable, UpsertTable
from spanwise.streaming.state import state_rows, state_table

__all__ = ["LateTable", "Monitor", "ProgressTable", "UpsertTable", "back_to_back_stream", "progress", "run_stream",
           "run_to_end", "shared_folder", "state_rows", "state_table", "stream_result"]
