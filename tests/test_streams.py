"""Streams with late events give what a batch gives."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import features, windows
from isochron.streaming import graph, trailing

START = datetime.datetime(2020, 1, 1)


def run(spark, tmp_path, rows, schema, make, name):
    """Feed each list of rows as one file and trigger; returns what the stream appended."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_late_events_are_sorted_in(spark, tmp_path):
    events = [(i % 3, i, at(i * 10 + (137 * i) % 50)) for i in range(120)]
    order = sorted(events, key=lambda e: (e[1] * 10 + (71 * e[1]) % 90))  # up to 90 s out of order
    parts = [order[lo : lo + 30] for lo in range(0, 120, 30)] + [[(r, 1000 + r, at(10_000)) for r in range(3)], [(0, 2000, at(20_000))]]
    schema = "record long, event_id long, ts timestamp"
    got = run(spark, tmp_path, parts, schema, lambda s: trailing.sorted_rhythm(s, "5 minutes"), "sorted_rhythm")
    rows = spark.createDataFrame(events, schema).withColumn("t", F.unix_micros("ts") / 1e6)
    want = windows.rhythm(windows.intervals(rows, "record", ["t", "event_id"], "t"), "record", ["t", "event_id"])
    columns = ["event_id", "pos", "n_rr", "mean_rr", "sdnn", "rmssd", "pnn", "lfhf"]
    a, b = (sorted(map(tuple, df.where("event_id < 1000").select(*columns).collect())) for df in (got, want))
    assert len(a) == 120 and all(x == pytest.approx(y, abs=1e-6) for x, y in zip(a, b, strict=True))
    assert got.where("rr_pre < 0").count() == 0


def test_windows_with_a_watermark(spark, tmp_path):
    schema = "record long, label string, ts timestamp"
    events = [(i % 2, "NS"[i % 2], at(i * 60)) for i in range(40)]
    parts = [events[:20], events[20:], [(9, "Q", at(1_000_000))], [(9, "Q", at(1_000_001))]]
    for name, make, n in (("tumbling", lambda s: trailing.label_rates(s, "10 minutes", "1 hour"), 1), ("sliding", lambda s: trailing.label_rates(s, "10 minutes", "1 hour", "5 minutes"), 2)):
        rows = run(spark, tmp_path / name, parts, schema, make, name).where("label <> 'Q'").collect()
        assert sum(r["n"] for r in rows) == 40 * n
    rows = run(spark, tmp_path / "session", [[e for e in events if e[0] == 0 or e[2] < at(900)], [(0, "N", at(9000))], *parts[2:]], schema,
               lambda s: trailing.session_rates(s, "30 minutes", "3 hours"), "sessions").where("record < 9").collect()
    assert sorted((r["record"], r["n"]) for r in rows) == [(0, 1), (0, 20), (1, 7)]


def described_beats(spark):
    """Beats of three records with late ones, a constant segment and one with a gap."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(105):
        segment = rng.normal(size=32).cumsum().tolist() if i % 17 != 5 else [1.0] * 32
        rows.append((f"r{i % 3}", i, at(i * 10 + (137 * i) % 50), segment))
    beats = spark.createDataFrame(rows, "record string, event_id long, ts timestamp, segment array<double>")
    return [tuple(r) for r in features.descriptor(beats, "segment").select("record", "event_id", "ts", "descriptor").collect()]


def test_features_of_arriving_beats_over_a_restart(spark, tmp_path):
    beats = described_beats(spark)
    schema = "record string, event_id long, ts timestamp, descriptor array<double>"
    order = sorted(beats, key=lambda e: (e[1] * 10 + (71 * e[1]) % 90))
    ends = [[(f"r{r}", 1000 + r, at(10_000), [1.0] * 5) for r in range(3)], [("r0", 2000, at(20_000), [1.0] * 5)], [("r0", 2001, at(20_001), [1.0] * 5)]]
    parts = [order[lo : lo + 35] for lo in range(0, 105, 35)] + ends
    into, out = tmp_path / "in", str(tmp_path / "out")
    for n in (2, len(parts)):  # the second stream goes on from the checkpoint of the first
        for i in range(0 if n == 2 else 2, n):
            spark.createDataFrame(parts[i], schema).coalesce(1).write.parquet(str(into / f"{i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(into))
        q = graph.beat_features(stream, "5 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    rows = spark.createDataFrame(beats, schema).withColumn("t", F.unix_micros("ts") / 1e6)
    want = windows.rhythm(windows.intervals(rows, "record", ["t", "event_id"], "t"), "record", ["t", "event_id"])
    want = features.graph_features(want, "record", ["t", "event_id"])
    columns = ["record", "event_id", "pos", "n_rr", "mean_rr", "sdnn", "rmssd", "pnn", "lfhf", "gr_wdegree", "gr_clustering", "gr_pagerank"]
    a, b = (sorted(map(tuple, df.where("event_id < 1000").select(*columns).collect())) for df in (spark.read.parquet(out), want))
    assert len(a) == 105
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-6)
    assert sum(x[-1] > 0 for x in a) > 90


def test_a_silent_record_starts_anew(spark, tmp_path):
    schema = "record string, event_id long, ts timestamp, descriptor array<double>"
    d = [1.0, 2.0, 3.0, 4.0, 5.0]
    parts = [[("a", i, at(10 * i), d) for i in range(5)], [("b", 50, at(5000), d)], [("b", 51, at(6000), d)], [("a", 60, at(7000), d)], [("b", 70, at(9000), d)], [("b", 71, at(9001), d)]]
    rows = run(spark, tmp_path, parts, schema, lambda s: graph.beat_features(s, "1 minute", idle=600.0), "silent").where("record = 'a'").collect()
    assert sorted((r["event_id"], r["pos"]) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (60, 0)]
