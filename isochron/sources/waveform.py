"""Waveform records as a Spark data source: planned byte ranges, records chosen before any file of them is opened.

    spark.dataSource.register(WaveformSource)
    spark.read.format("waveform").option("block", 65536).option("records", "100,101").load("/data/records")

gives blocks (record, lead, idx, fs, n, block, start, samples): each row has the samples
start .. start + block of one channel, n is the channel's length.  No row and no batch holds a record.

Records are chosen by an option and not by pushed filters: Spark 4.1 plans a loaded Python source
once, so a table that is filtered by record and then used whole (``df.union(df.where(...))``) would
keep the first filter's partitions and lose rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "record string, lead string, idx int, fs double, n long, block long, start long, samples array<double>"
#: Bytes and samples of a code group of each signal format, and the code of a missing sample.
FORMATS = {"16": (2, 1, -32768), "61": (2, 1, -32768), "80": (1, 1, -128), "212": (3, 2, -2048), "24": (3, 1, -8388608), "32": (4, 1, -2147483648)}
_FORMAT = re.compile(r"(\d+)(?:x(\d+))?(?::(\d+))?(?:\+(\d+))?")


def parse_record(text: str) -> dict:
    """record, fs, frames (0: not said) and channels of a header, each with its file, format, samples a frame and first byte."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0].split()
    if "/" in first[0]:
        raise ValueError(f"record {first[0]} has segments of its own; read these")
    channels = []
    for line in lines[1 : 1 + int(first[1])]:
        f = line.split()
        form = _FORMAT.fullmatch(f[1])
        if not form or form[1] not in FORMATS or int(form[3] or 0):
            raise ValueError(f"signal format {f[1]} is not supported")
        gain = re.match(r"(-?[\d.eE+]+)(?:\((-?\d+)\))?", f[2] if len(f) > 2 else "200")
        zero = int(f[4]) if len(f) > 4 else 0
        channels.append({"file": f[0], "format": form[1], "per_frame": int(form[2] or 1), "skip": int(form[4] or 0), "gain": float(gain[1]) or 200.0,
                         "baseline": int(gain[2]) if gain[2] else zero, "name": " ".join(f[8:]) or f"ch{len(channels)}"})
    frames = int(first[3]) if len(first) > 3 else 0
    return {"record": first[0], "fs": float(first[2].split("/")[0]) if len(first) > 2 else 250.0, "frames": frames, "channels": channels}


def decode(data: bytes, form: str) -> np.ndarray:
    """Samples of a byte range that begins at a code group."""
    if form in ("16", "61", "32"):
        return np.frombuffer(data, {"16": "<i2", "61": ">i2", "32": "<i4"}[form]).astype(np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if form == "80":
        return b - 128
    b = b[: len(b) // 3 * 3].reshape(-1, 3)
    if form == "24":
        out = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return np.where(out >= 1 << 23, out - (1 << 24), out)
    out = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4], axis=1).ravel()
    return np.where(out > 2047, out - 4096, out)


def _opened(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:(?!//)", "file://", path))


class Span(InputPartition):
    """What a task reads: (header facts, file, its channels' numbers, first frame, frames, frames of the record)."""

    def __init__(self, spans: list[tuple]):
        super().__init__(None)
        self.spans = spans


class WaveformReader(DataSourceReader):
    def __init__(self, path: str, block: int, task_bytes: int, records: set[str] | None, first_only: bool):
        self.path, self.block, self.task_bytes, self.records, self.first_only = path.rstrip("/"), block, task_bytes, records, first_only

    def partitions(self) -> Sequence[Span]:
        """One listing of the folder; headers of the records asked for only; no signal is opened."""
        from pyarrow import fs as pafs

        fs, root = _opened(self.path)
        sizes = {f.path.rsplit("/", 1)[-1]: f.size for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file}
        names = sorted(x[:-4] for x in sizes if x.endswith(".hea") and (self.records is None or x[:-4] in self.records))

        def header(name: str) -> dict:
            with fs.open_input_stream(f"{root}/{name}.hea") as f:
                return parse_record(f.read().decode("latin-1"))

        spans, out, held = [], [], 0
        with ThreadPoolExecutor(16) as pool:
            for head in pool.map(header, names):
                for file in dict.fromkeys(c["file"] for c in head["channels"]):
                    own = [i for i, c in enumerate(head["channels"]) if c["file"] == file]
                    first = head["channels"][own[0]]
                    if any((head["channels"][i]["format"], head["channels"][i]["skip"]) != (first["format"], first["skip"]) for i in own):
                        raise ValueError(f"channels of {file} differ in format")
                    size, group, _ = FORMATS[first["format"]]
                    width = sum(head["channels"][i]["per_frame"] for i in own)
                    there = (sizes.get(file, 0) - first["skip"]) // size * group // width
                    frames = min(head["frames"], there) if head["frames"] else there
                    step = self.block + self.block % 2  # whole code groups: an even number of frames
                    for at in range(0, min(frames, 1) if self.first_only else frames, step):
                        n = min(step, frames - at)
                        if held and held + n * width * size // group > self.task_bytes:
                            out.append(Span(spans))
                            spans, held = [], 0
                        spans.append((head, file, own, at, n, frames))
                        held += n * width * size // group
        return [*out, Span(spans)] if spans else out or [Span([])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.path)
        schema = pa.schema([("record", pa.string()), ("lead", pa.string()), ("idx", pa.int32()), ("fs", pa.float64()), ("n", pa.int64()), ("block", pa.int64()),
                            ("start", pa.int64()), ("samples", pa.list_(pa.float64()))])
        for head, file, own, at, n, frames in partition.spans:
            channels = [head["channels"][i] for i in own]
            size, group, missing = FORMATS[channels[0]["format"]]
            width = sum(c["per_frame"] for c in channels)
            with fs.open_input_file(f"{root}/{file}") as f:
                f.seek(channels[0]["skip"] + at * width // group * size)
                raw = decode(f.read(-(-n * width // group) * size), channels[0]["format"])[: n * width].reshape(n, width)
            left = 0
            for i, c in zip(own, channels, strict=True):
                k = c["per_frame"]
                x = raw[:, left : left + k].ravel()
                left += k
                values = pa.array((x - c["baseline"]) / c["gain"], mask=x == missing)
                step = (self.block + self.block % 2) * k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head["record"]]), pa.array([c["name"]]), pa.array([i], pa.int32()), pa.array([head["fs"] * k]), pa.array([frames * k]), pa.array([step]),
                     pa.array([at * k]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), values)], schema=schema)


class WaveformSource(DataSource):
    """Options: path, ``block`` (frames a row, 65536), ``taskBytes`` (bytes of signal a task, 32 MB), ``records``
    (names with commas between; all), ``firstOnly`` (the first block of each channel only, false)."""

    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveformReader:
        o = self.options
        records = {x.strip() for x in o["records"].split(",")} if o.get("records") is not None else None
        return WaveformReader(o["path"], int(o.get("block", 65536)), int(o.get("taskBytes", 32 << 20)), records, str(o.get("firstOnly", "false")).lower() == "true")


def read_blocks(spark: SparkSession, path: str, block: int = 65536, task_bytes: int = 32 << 20, records: list[str] | None = None, first_only: bool = False) -> DataFrame:
    """Blocks of the records of a folder, all or some; missing samples are null."""
    spark.dataSource.register(WaveformSource)
    out = spark.read.format("waveform").option("block", block).option("taskBytes", task_bytes).option("firstOnly", first_only)
    return (out if records is None else out.option("records", ",".join(records))).load(path)
