"""Waveform files in byte ranges, and long signals in blocks, against whole records."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.functions import kernels as K
from isochron.operators import blocks, tables
from isochron.sources import waveform, wfdb


def encode(x, form):
    if form == "212":
        return wfdb.encode_212(x.ravel())
    if form == "24":
        return b"".join(int(v).to_bytes(3, "little", signed=True) for v in x.ravel())
    if form == "80":
        return (x.ravel() + 128).astype(np.uint8).tobytes()
    return x.astype({"16": "<i2", "61": ">i2", "32": "<i4"}[form]).tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Records of several rates, formats, signal files, samples a frame, and one with missing samples and a prologue."""
    at, rng, whole = tmp_path_factory.mktemp("waves"), np.random.default_rng(6), {}
    plan = {"a": (360, [("a.dat", "212", 2, 1, 0)], 5003), "b": (257, [("b1.dat", "16", 1, 1, 0), ("b2.dat", "61", 2, 1, 24)], 4096), "c": (250, [("c.dat", "80", 1, 2, 0)], 999),
            "d": (360, [("d.dat", "24", 1, 1, 0), ("e.dat", "32", 1, 1, 7)], 700)}
    for name, (fs, files, n) in plan.items():
        lines, k = [f"{name} {sum(f[2] for f in files)} {fs} {n if name != 'c' else ''}"], 0
        for file, form, channels, per, skip in files:
            lim = 100 if form == "80" else 1000
            x = np.clip(np.cumsum(rng.integers(-9, 10, (n, channels * per)), axis=0), -lim, lim)
            if name == "a":
                x[100:103, 1] = -2048
            (at / file).write_bytes(b"\7" * skip + encode(x, form))
            for c in range(channels):
                lead = f"L{k}"
                lines.append(f"{file} {form}{f'x{per}' if per > 1 else ''}{f'+{skip}' if skip else ''} 200({5 if c else 0}) 11 {0 if c else 3} 0 0 0 {lead}")
                own = x[:, c * per : (c + 1) * per].ravel().astype(float)
                y = (own - (5 if c else 0)) / 200
                whole[name, lead] = (fs * per, np.where(own == -2048, np.nan, y))
                k += 1
        (at / f"{name}.hea").write_text("\n".join(lines) + "\n# age: 70\n")
    return str(at), whole


def joined(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["record"], r["lead"]), []).append((r["start"], r["fs"], r["n"], r["samples"]))
    for key, parts in out.items():
        parts.sort(key=lambda p: p[:1])
        x = np.array([np.nan if v is None else v for p in parts for v in p[3]], float)
        assert [p[0] for p in parts] == np.cumsum([0, *(len(p[3]) for p in parts[:-1])]).tolist() and len(x) == parts[0][2]
        out[key] = (parts[0][1], x)
    return out


@pytest.mark.parametrize("block,task", [(65536, 32 << 20), (101, 3000)])
def test_channels_of_all_formats(spark, folder, block, task):
    path, whole = folder
    df = waveform.read_blocks(spark, path, block, task)
    got = joined(df)
    assert set(got) == set(whole)
    for key, (fs, x) in whole.items():
        assert got[key][0] == fs and np.allclose(got[key][1], x, rtol=1e-12, equal_nan=True)
    if block == 101:
        assert df.rdd.getNumPartitions() > 5 and df.agg(F.max(F.size("samples"))).first()[0] <= 204


def test_only_files_of_chosen_records_are_opened(spark, folder, tmp_path):
    path, whole = folder
    for name in os.listdir(path):
        (tmp_path / name).write_bytes(open(os.path.join(path, name), "rb").read() if name.startswith(("a", "d", "e")) else b"broken")
    read = lambda *a, **k: waveform.read_blocks(spark, str(tmp_path), *a, **k)
    assert set(joined(read(records=["a"]))) == {("a", "L0"), ("a", "L1")}
    df = read(records=["d", "a"])
    assert {r[0] for r in df.select("record").collect()} == {"a", "d"}
    assert df.union(df.where("record = 'a'")).count() == 6 and df.count() == 4  # one table, filtered in two ways
    first = read(100, records=["a"], first_only=True)
    assert first.count() == 2 and first.rdd.getNumPartitions() == 1
    assert read(records=["nobody"]).count() == 0
    with pytest.raises(Exception, match="broken|split|list index|invalid"):
        read().count()


def test_filters_and_moments_by_blocks(spark, folder):
    path, whole = folder
    df = waveform.read_blocks(spark, path, 150).where("record IN ('a', 'b', 'd')")
    clean = df.where("NOT (record = 'a' AND lead = 'L1')")
    stats = {(r["record"], r["lead"]): (r["mean"], r["sd"]) for r in blocks.moments(df).collect()}
    for key, found in stats.items():
        assert found == pytest.approx((np.nanmean(whole[key][1]), np.nanstd(whole[key][1])), rel=1e-12)
    for fs in (360, 257):
        own = joined(blocks.bandpassed(clean.where(F.col("fs") == fs), float(fs)))
        assert own
        for key, (_, x) in own.items():
            assert np.abs(x - K.bandpass(whole[key][1][None], float(fs))[0]).max() < 1e-9
    for key, (fs, x) in joined(blocks.resampled(clean, 360)).items():
        want = K.resample(whole[key][1][None], 360, int(whole[key][0]))[0]
        assert fs == 360 and len(x) == len(want) and np.abs(x - want).max() < 1e-9


def test_beats_of_blocks_are_those_of_whole_records(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name in ("r1", "r2"):
        x = np.clip(np.cumsum(rng.integers(-9, 10, (3000, 2)), axis=0), -900, 900)
        (tmp_path / f"{name}.dat").write_bytes(encode(x, "16"))
        (tmp_path / f"{name}.hea").write_text(f"{name} 2 360 3000\n" + "".join(f"{name}.dat 16 200 11 0 0 0 0 {lead}\n" for lead in ("MLII", "V1")))
        (tmp_path / f"{name}.atr").write_bytes(wfdb.encode_annotations([(int(s), "NVx"[i % 3] if i % 5 else "N") for i, s in enumerate(range(40, 3000, 97))]))
    notes = wfdb.read_annotations(spark, str(tmp_path))
    want = wfdb.beats(wfdb.read_signals(spark, str(tmp_path)), notes, tables.SYMBOLS).collect()
    got = blocks.beats(waveform.read_blocks(spark, str(tmp_path), 100), notes, tables.SYMBOLS, firsts=waveform.read_blocks(spark, str(tmp_path), 100, first_only=True)).collect()
    key = lambda r: (r["record"], r["lead"], r["sample"])
    assert len(got) == len(want) > 80
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(a[c] == b[c] for c in ("record", "sample", "pos", "label", "rr_pre", "rr_post", "lead", "idx", "fs"))
        assert a["segment"] == pytest.approx(b["segment"], abs=1e-9)
