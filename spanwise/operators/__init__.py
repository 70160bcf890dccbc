"""Operators on spans and signals: frames in, frames out."""

from spanwise.operators.mobility import (
    merge_sketches,
    mobility,
    mobility_packed,
    mobility_sketches,
    mobility_upserts,
    sketched_mobility,
)
from spanwise.operators.sessions import back_to_back, back_to_back_packed
from spanwise.operators.signals import rebuild_spans, split_spans

__all__ = [
    "back_to_back",
    "back_to_back_packed",
    "merge_sketches",
    "mobility",
    "mobility_packed",
    "mobility_sketches",
    "mobility_upserts",
    "rebuild_spans",
    "sketched_mobility",
    "split_spans",
]
