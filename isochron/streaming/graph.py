"""Rhythm and graph features of each arriving beat, from a bounded state per record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels as K
from .trailing import UNITS, _advance, _closed, _opened

SCHEMA = ("record {record}, event_id long, pos int, rr_pre double, n_rr long, mean_rr double, sdnn double, rmssd double, pnn double, lfhf double, "
          "gr_wdegree double, gr_clustering double, gr_pagerank double")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep states of streams in RocksDB, which lists and timers need; a session that names a store of its own keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name, "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, ROCKS)


def frame_graph(frame: np.ndarray, tau: float) -> tuple[float, float, float]:
    """Weighted degree, clustering and PageRank of the last of a frame's descriptors; a descriptor with a gap has no edges."""
    if len(frame) < 3:
        return 0.0, 0.0, 0.0
    whole = np.where(np.isfinite(frame).all(axis=1, keepdims=True), frame, 0.0)
    graph, node = K.similarity_graph(whole[None], tau), len(frame) - 1
    return float(graph[0, node].sum()), float(K.clustering(graph, node)[0]), float(K.pagerank(graph)[0, node])


class BeatFeatures(StatefulProcessor):
    """State of a record: beats that wait for the watermark, the last ``width`` descriptors and intervals, its place and last time.

    A timer wakes a record when the watermark passes its oldest waiting beat, and once more
    ``idle`` seconds after its last beat, when it is forgotten.
    """

    def __init__(self, width: int, tau: float, jump: float, idle: float):
        self.width, self.tau, self.jump, self.idle = width, tau, jump, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, event_id long, descriptor array<double>")
        self.descriptors = handle.getListState("descriptors", "descriptor array<double>")
        self.place = handle.getValueState("place", "pos int, last double, buffer array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            t = part["ts"].astype("int64") / UNITS[part["ts"].dt.unit]
            new += zip(t.tolist(), part["event_id"].tolist(), (_gaps(d) for d in part["descriptor"]), strict=True)
        self.waiting.appendList(new)
        yield from self._passed(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def _passed(self, key, mark: float) -> Iterator[pd.DataFrame]:
        """The rows of beats that the watermark has passed; sets the next timer."""
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((b for b in held if b[0] <= mark), key=lambda b: b[:2])
        pos, last, buffer = self.place.get() if self.place.exists() else (0, None, [])
        if ready:
            rest = [b for b in held if b[0] > mark]
            rows, pos, last, buffer = _advance(key[0], [b[:2] for b in ready], pos, last, _opened(buffer), self.width, self.jump)
            frame = [d[0] for d in self.descriptors.get()] if self.descriptors.exists() else []
            out = []
            for row, beat in zip(rows, ready, strict=True):
                frame = [*frame, beat[2]][-self.width :]
                out.append((*row, *frame_graph(np.array(frame, dtype=float), self.tau)))
            self.descriptors.put([(d,) for d in frame])
            self.place.update((pos, last, _closed(buffer)))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            held = rest
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = min(b[0] for b in held) if held else (last if last is not None else mark) + self.idle
        if not held and wake <= mark:
            for state in (self.waiting, self.descriptors, self.place):
                state.clear()
        else:
            self.handle.registerTimer(max(int(np.ceil(wake * 1000)), int(mark * 1000) + 1))

    def close(self) -> None:
        pass


def _gaps(descriptor) -> list[float]:
    return [float("nan") if v is None else float(v) for v in descriptor]


def beat_features(beats: DataFrame, late: str = "10 minutes", width: int = 16, tau: float = 8.0, jump: float = 0.05, idle: float = 86400.0) -> DataFrame:
    """beats (record, event_id, ts, descriptor) as a stream in any order: a row per beat once the watermark has passed it.

    The rows are those of ``windows.rhythm`` and ``features.graph_features`` over the beats in
    the order of (ts, event_id), ts to the millisecond: beats wait in their record's state until none that is older can
    come, then the frame moves on beat by beat.  State is what waits and ``width`` beats; a record
    silent for ``idle`` seconds of event time is forgotten and starts anew.  Records, times and
    descriptors must not be null; values of a descriptor may be.
    """
    use_state_store(beats.sparkSession)
    kept = beats.withWatermark("ts", late).select("record", "event_id", "ts", "descriptor")
    return kept.groupBy("record").transformWithStateInPandas(
        BeatFeatures(width, tau, jump, idle), SCHEMA.format(record=dict(beats.dtypes)["record"]), "append", "eventTime")
