"""Signal kernels and distribution functions against closed forms and published values."""

import math

import numpy as np
import pytest

from isochron.functions import kernels as K
from isochron.functions import stats


def test_welch_finds_a_sine_and_its_power():
    t = np.arange(512) / 128.0
    f, p = K.welch(np.sin(2 * np.pi * 10 * t)[None], 128.0)
    assert f[p[0].argmax()] == 10 and abs(np.trapezoid(p[0], f) - 0.5) < 0.02
    shares, entropy = K.band_shares(np.stack([np.sin(2 * np.pi * 10 * t), np.random.default_rng(0).normal(size=512)]), 128.0)
    assert shares["mid"][0] > 0.9 and entropy[0] < entropy[1]


def test_narrow_low_band_holds_one_bin_only():
    x = np.random.default_rng(1).normal(size=(3, 252))
    assert (K.band_shares(x, 360.0)[0]["low"] == 0).all()


def test_wavelet_lengths_and_energy():
    x = np.random.default_rng(2).normal(size=(1, 252))
    lengths = []
    for _ in range(4):
        x = K._analyse(x, K.DB4)
        lengths.append(x.shape[1])
    assert lengths == [129, 68, 37, 22]
    impulse = np.zeros((1, 64))
    impulse[0, 32] = 1
    high = K.DB4[::-1] * np.where(np.arange(8) % 2, 1.0, -1.0)
    energy = (K._analyse(impulse, K.DB4) ** 2).sum() + (K._analyse(impulse, high) ** 2).sum()
    assert abs(energy - 1) < 1e-9  # orthogonal filters keep energy
    assert abs(K._analyse(np.ones((1, 64)), high)).max() < 1e-9


def test_bandpass_is_zero_phase_and_selective():
    fs, t = 360.0, np.arange(7200) / 360.0  # the lowest edge, 0.5 Hz, rings for seconds
    mid, slow, fast = (np.sin(2 * np.pi * f * t) for f in (10.0, 0.05, 120.0))
    y = K.bandpass(np.stack([mid, slow, fast]), fs)
    core = slice(2400, 4800)
    assert np.abs(y[0] - mid)[core].max() < 0.02 and np.abs(y[2])[core].max() < 0.02 and np.abs(y[1])[core].max() < 0.3
    sections = K.butterworth(4, 0.5, 40.0, fs)

    def gain(f):
        z = np.exp(2j * np.pi * f / fs)
        return np.prod([abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)) for b0, b1, b2, a1, a2 in sections])

    assert gain(0.5) == pytest.approx(1 / math.sqrt(2), abs=1e-3) and gain(40.0) == pytest.approx(1 / math.sqrt(2), abs=1e-3)
    assert gain(5.0) == pytest.approx(1.0, abs=1e-3)


def test_resampling_keeps_a_slow_wave():
    x = np.sin(2 * np.pi * 3 * np.arange(514) / 257)[None]
    y = K.resample(x, 360, 257)
    want = np.sin(2 * np.pi * 3 * np.arange(y.shape[1]) / 360)
    assert y.shape[1] == 720 and np.abs(y[0] - want)[60:-60].max() < 0.01
    assert np.array_equal(K.resample(x, 360, 360), x)


def test_graph_of_equal_nodes():
    w = K.similarity_graph(np.ones((1, 4, 3)), 1e12)
    assert np.allclose(w[0], 1 - np.eye(4))
    assert np.allclose(K.clustering(w, 0), 1) and np.allclose(K.pagerank(w), 0.25, atol=1e-5)
    chain = np.zeros((1, 3, 3))
    chain[0, 0, 1] = chain[0, 1, 0] = chain[0, 1, 2] = chain[0, 2, 1] = 1
    assert K.clustering(chain, 1)[0] == 0
    r = K.pagerank(chain)[0]
    assert abs(r.sum() - 1) < 1e-6 and r[1] > r[0] == pytest.approx(r[2])


def test_morphology_of_a_box():
    x = np.zeros((1, 100))
    x[0, 40:51] = -2.0
    out = K.morphology(x, 100.0)
    assert out["r_amp"][0] == -2 and out["qrs_ms"][0] == pytest.approx(100.0) and 0 < out["energy_ratio"][0] < 1


def test_distributions():
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.7764451052, abs=1e-8)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-6)
    assert stats.chi2_sf(3.841458821) == pytest.approx(0.05, abs=1e-9)
    assert stats.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-8)
    w, p = stats.wilcoxon([1.0, 2.0, 3.0, 4.0, 5.0])
    assert (w, p) == (0, 0.0625)
    assert stats.wilcoxon([0.0, 0.0]) == (0.0, 1.0)
    assert stats.paired_t([1, 2, 3], [1, 2, 3]) == (0.0, 1.0)


def test_graph_frames_do_not_travel_whole(spark, monkeypatch):
    """Blocks of beats with what their frames reach give the rows of one block; no row carries a frame of frames."""
    from pyspark.sql import functions as F

    from isochron.operators import features

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i % 2, i, rng.normal(size=5).tolist()) for i in range(90)], "r long, t long, descriptor array<double>")
    for causal in (True, False):
        got = []
        for block in (7, 2048):
            monkeypatch.setattr(features, "BLOCK", block)
            out = features.graph_features(df, "r", ["t"], width=6, causal=causal)
            assert "_frame" not in out._jdf.queryExecution().optimizedPlan().toString()
            got.append([tuple(r) for r in out.select("r", "t", *(F.round(c, 12) for c in ("gr_wdegree", "gr_clustering", "gr_pagerank"))).orderBy("r", "t").collect()])
        assert len(got[0]) == 90 and got[0] == got[1]
