"""The named queries: which table they read, how, and with which event time on a stream.

Every function takes a frame of its table (``read_spans`` gives one) and works on batch and, where
the catalog names a watermark, on streams. The defaults are the customary constants; the same
question is asked with different windows, times and gap rules under different names on purpose.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators import (
    back_to_back,
    back_to_back_packed,
    mobility,
    mobility_packed,
    rebuild_spans,
)
from spanwise.operators.signals import START, WINDOW_BOUNDS, stream_lag
from spanwise.streaming.sessions import back_to_back_stream

_ID, _TOWER, _CALLER = "unique_id", "tower_id", "calling_party"
_CALL = (_CALLER, "start_time", "end_time", _ID)


def _starts(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("event_type") == START)


def mobility_mono_5s_exact(towers: DataFrame, width: int = 5000, threshold: int = 2) -> DataFrame:
    """Towers per id and packed bucket of the END, exactly, in order of bucket and id."""
    return mobility_packed(towers, _ID, _TOWER, "end_ts", width, threshold)


def mobility_mono_5s_approx(towers: DataFrame, window: str = "5 seconds", threshold: int = 2) -> DataFrame:
    """Towers per id and window of the END, approximately."""
    return mobility(towers, _ID, _TOWER, "end_time", window, threshold, approx=True)


def mobility_bi_5s_approx(signals: DataFrame, window: str = "5 seconds", threshold: int = 2) -> DataFrame:
    """Towers per id and window of the ENTER signal, approximately."""
    return mobility(_starts(signals), _ID, _TOWER, "event_time", window, threshold, approx=True)


def mobility_bi_total(signals: DataFrame, threshold: int = 5) -> DataFrame:
    """Towers per id over all time, exactly."""
    return mobility(_starts(signals), _ID, _TOWER, window=None, threshold=threshold)


def mobility_mono_5m(towers: DataFrame, window: str = "5 minutes", threshold: int = 5) -> DataFrame:
    """Towers per id and window of the START, exactly."""
    return mobility(towers, _ID, _TOWER, "start_time", window, threshold)


def mobility_bi_5m(signals: DataFrame, window: str = "5 minutes", threshold: int = 5) -> DataFrame:
    """Towers per id and window of the ENTER signal, exactly."""
    return mobility(_starts(signals), _ID, _TOWER, "event_time", window, threshold)


def b2b_mono_packed(calls: DataFrame, max_gap: int = 10_000) -> DataFrame:
    """Calls that follow the caller's call before, by difference of packed digits."""
    return back_to_back_packed(calls, _CALLER, "start_ts", "end_ts", _ID, max_gap)


def b2b_bi_packed(signals: DataFrame, max_gap: int = 10_000, one_per_id: bool = False,
                  count_copies: bool = False) -> DataFrame:
    """The same on calls rebuilt from their signals by id alone.

    ``count_copies`` counts equal signals before they are paired, so that copies travel as numbers; it costs
    one more shuffle and pays where signals repeat much.
    """
    copies = "copies" if count_copies and not one_per_id else None
    calls = rebuild_spans(signals, _ID, keep=[_CALLER], time="event_ts", one_per_id=one_per_id, copies=copies)
    return back_to_back_packed(calls, _CALLER, "start_time", "end_time", _ID, max_gap, copies=copies)


def b2b_mono(calls: DataFrame, max_gap_s: int = 10, **slices: int) -> DataFrame:
    """Calls that follow the caller's call before within whole seconds; all dispositions.

    A batch frame also takes ``one_shuffle`` (see ``back_to_back``).
    """
    look_back = back_to_back_stream if calls.isStreaming else back_to_back
    return look_back(calls, *_CALL, max_gap_s, **slices)


def b2b_bi(signals: DataFrame, bound: str = "4 minutes", max_gap_s: int = 10, one_per_id: bool = False,
           count_copies: bool = False, window_bounds: int = WINDOW_BOUNDS, **slices: int) -> DataFrame:
    """The same on connected calls, rebuilt from signals of equal id and caller within ``bound``.

    The filters come before the look back: they decide which call is the one before. ``one_per_id`` (see
    ``rebuild_spans``) and ``count_copies`` (see ``b2b_bi_packed``) are for batch frames, ``window_bounds`` is for streams.
    """
    connected = signals.where(F.col("disposition") == "connected")
    if signals.isStreaming:
        if one_per_id or count_copies:
            raise ValueError("one_per_id and count_copies have no streaming form")
        calls = rebuild_spans(connected, _ID, [_CALLER], bound, one_scan=True, closes="closes_at", window_bounds=window_bounds)
        closes = ("closes_at", stream_lag(bound, window_bounds))
        return back_to_back_stream(calls, *_CALL, max_gap_s, closes=closes, longest=bound, **slices)
    copies = "copies" if count_copies and not one_per_id else None
    calls = rebuild_spans(connected, _ID, [_CALLER], bound, one_per_id=one_per_id, copies=copies)
    return back_to_back(calls, *_CALL, max_gap_s, copies=copies, **slices)


@dataclass(frozen=True)
class Query:
    """A named query: its table, its plan and, if it can run on a stream, its watermark."""

    table: str
    plan: Callable[..., DataFrame]
    watermark: tuple[str, str] | None = None

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        if df.isStreaming:
            if self.watermark is None:
                raise ValueError("this query has no streaming form")
            df = df.withWatermark(*self.watermark)
        return self.plan(df, **params)

    def settings(self, **params) -> dict:
        """All parameters of the plan with those given, as a checkpoint must keep them."""
        known = dict(inspect.signature(self.plan).parameters)
        if "slices" in known:
            known |= {n: p for n, p in inspect.signature(back_to_back_stream).parameters.items() if n in ("slice_s", "lanes")}
        return {n: params.get(n, p.default) for n, p in known.items() if p.default is not p.empty}


# Event-time column and allowed lateness of each streaming query.
CATALOG = {
    "mobility_mono_5s_exact": Query("mono_towers", mobility_mono_5s_exact),
    "mobility_mono_5s_approx": Query("mono_towers", mobility_mono_5s_approx, ("end_time", "1 second")),
    "mobility_bi_5s_approx": Query("bi_towers", mobility_bi_5s_approx, ("event_time", "0.001 seconds")),
    "mobility_bi_total": Query("bi_towers", mobility_bi_total),
    "mobility_mono_5m": Query("mono_towers", mobility_mono_5m, ("start_time", "10 minutes")),
    "mobility_bi_5m": Query("bi_towers", mobility_bi_5m, ("event_time", "5 seconds")),
    "b2b_mono_packed": Query("mono_calls", b2b_mono_packed),
    "b2b_bi_packed": Query("bi_calls", b2b_bi_packed),
    "b2b_mono": Query("mono_calls", b2b_mono, ("start_time", "15 minutes")),
    "b2b_bi": Query("bi_calls", b2b_bi, ("event_time", "10 minutes")),
    "b2b_batch": Query("mono_calls", b2b_mono),
}
