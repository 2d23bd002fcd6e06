"""Interval statistics of each arriving event from a bounded buffer per record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "record long, event_id long, pos int, rr_pre double, n_rr long, mean_rr double, sdnn double, rmssd double, pnn double, lfhf double"
STATE = "pos int, last double, buffer array<double>"


#: State of a record that sorts: events not yet in order, beside the state of one in order.
SORTED = STATE + ", waiting array<double>, ids array<long>"


def _advance(record, events, pos: int, last: float | None, buffer: list, width: int, jump: float) -> tuple[list[tuple], int, float | None, list]:
    """Rows of events (t, event_id) in order, and the state after them."""
    rows = []
    for t, event_id in events:
        rr = None if last is None else t - last
        buffer = [*buffer, rr][-width:]
        x = np.array([v for v in buffer if v is not None])
        d, n = np.diff(x), len(x)
        on = n >= 3
        rows.append((record, event_id, pos, rr, n, x.mean() if n else 0.0, x.std() if on else 0.0, np.sqrt((d**2).mean()) if on else 0.0,
                     (np.abs(d) > jump).mean() if on else 0.0, float(n >= 8)))
        pos, last = pos + 1, t
    return rows, pos, last, buffer


def _opened(buffer: list) -> list:
    return [None if x is None or np.isnan(x) else x for x in buffer]


def _closed(buffer: list) -> list:
    return [float("nan") if v is None else v for v in buffer]


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def trailing_rhythm(events: DataFrame, width: int = 16, jump: float = 0.05) -> DataFrame:
    """events (record, event_id, t) as a stream that is in time order within a record: one row per event, at once.

    The state of a record is its last time and its last ``width`` intervals, whatever the
    stream's length.  A batch's events are sorted by (t, event_id) first.  Where events can
    come late, ``sorted_rhythm`` waits for them; here one would count with a negative interval.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, last, buffer = state.get if state.exists else (0, None, [])
        events = pd.concat(list(parts)).sort_values(["t", "event_id"])[["t", "event_id"]].itertuples(index=False)
        rows, pos, last, buffer = _advance(key[0], events, pos, last, _opened(buffer), width, jump)
        state.update((pos, last, _closed(buffer)))
        yield pd.DataFrame(rows, columns=NAMES)

    return events.groupBy("record").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def sorted_rhythm(events: DataFrame, late: str = "10 minutes", width: int = 16, jump: float = 0.05, idle: float = 86400.0) -> DataFrame:
    """events (record, event_id, ts) as a stream in any order: one row per event, once the watermark has passed it.

    Events wait in their record's state until none that is older can come (``late`` behind
    the newest time seen), then leave in order of (ts, event_id); later ones are dropped by
    the watermark.  So the rows are those of a batch over the events in time order.  State is
    what waits, the last time and ``width`` intervals; a record that is silent for ``idle``
    seconds of event time is forgotten and starts anew.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, last, buffer, waiting, ids = state.get if state.exists else (0, None, [], [], [])
        pending = list(zip(waiting, ids, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                pending += zip((part["ts"].astype("int64") / UNITS[part["ts"].dt.unit]).tolist(), part["event_id"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs() / 1000.0
        ready = sorted(e for e in pending if e[0] <= mark)
        pending = [e for e in pending if e[0] > mark]
        rows, pos, last, buffer = _advance(key[0], ready, pos, last, _opened(buffer), width, jump)
        if not pending and last is not None and last + idle <= mark:
            state.remove()
        else:
            state.update((pos, last, _closed(buffer), [t for t, _ in pending], [i for _, i in pending]))
            wake = min(t for t, _ in pending) if pending else (last if last is not None else mark) + idle
            state.setTimeoutTimestamp(max(int(wake * 1000), int(mark * 1000)) + 1)
        yield pd.DataFrame(rows, columns=NAMES)

    kept = events.withWatermark("ts", late).select("record", "event_id", "ts")
    return kept.groupBy("record").applyInPandasWithState(step, SCHEMA, SORTED, "append", GroupStateTimeout.EventTimeTimeout)


UNITS = {"s": 1, "ms": 1e3, "us": 1e6, "ns": 1e9}


def label_rates(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per label in tumbling windows, or in windows that ``slide``, with late events up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "label").agg(F.count(F.lit(1)).alias("n"))


def session_rates(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each record in sessions that end after a ``gap`` without events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "record").agg(F.count(F.lit(1)).alias("n"))
