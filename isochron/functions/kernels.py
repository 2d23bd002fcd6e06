"""Signal kernels over batches: arrays of shape (rows, samples)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

# The eight taps of the Daubechies-4 low-pass analysis filter.
DB4 = np.array([
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
])
# Frequency bands in Hz.
BANDS = {"low": (0.5, 5.0), "mid": (5.0, 15.0), "high": (15.0, 40.0)}


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix, without a Python object for each number; nulls in them are NaN."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def welch(x: np.ndarray, fs: float, nperseg: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: periodic Hann window, half overlap, each segment's mean removed."""
    n = min(x.shape[-1], nperseg)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[-1] - n + 1, n - n // 2)
    power = 0.0
    for s in starts:
        part = x[:, s : s + n]
        power = power + np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power = power / len(starts) / (fs * (window**2).sum())
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def band_shares(x: np.ndarray, fs: float, bands: dict = BANDS, nperseg: int = 128) -> tuple[dict, np.ndarray]:
    """Each band's share of the total area, and the spectral entropy."""
    f, p = welch(x, fs, nperseg)
    whole = np.trapezoid(p, f, axis=1) + 1e-12
    shares = {}
    for name, (lo, hi) in bands.items():
        own = (f >= lo) & (f < hi)
        shares[name] = np.trapezoid(p[:, own], f[own], axis=1) / whole if own.any() else np.zeros(len(x))
    q = p / (p.sum(axis=1, keepdims=True) + 1e-12)
    return shares, -(q * np.log(q + 1e-12)).sum(axis=1)


def _analyse(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filter the half-sample symmetric extension and keep every second value."""
    n = x.shape[1]
    k = np.arange((n + len(taps) - 1) // 2)
    at = 2 * k[:, None] + 1 - np.arange(len(taps))[None, :]
    at = np.mod(at, 2 * n)
    at = np.where(at >= n, 2 * n - 1 - at, at)
    return x[:, at] @ taps


def wavelet_energies(x: np.ndarray, level: int = 4, taps: np.ndarray = DB4) -> dict[str, np.ndarray]:
    """log(1 + energy) of the approximation and of each detail level."""
    high = taps[::-1] * np.where(np.arange(len(taps)) % 2, 1.0, -1.0)
    out = {}
    for i in range(1, level + 1):
        out[f"D{i}"] = np.log1p((_analyse(x, high) ** 2).sum(axis=1))
        x = _analyse(x, taps)
    return {f"A{level}": np.log1p((x**2).sum(axis=1)), **{f"D{i}": out[f"D{i}"] for i in range(level, 0, -1)}}


@lru_cache
def butterworth(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a digital Butterworth band-pass."""
    w1, w2 = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    centre, width = math.sqrt(w1 * w2), w2 - w1
    poles = []
    for k in range(order):
        p = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(p * p - centre**2 + 0j)
        poles += [p + root, p - root]
    z = (2 * fs + np.array(poles)) / (2 * fs - np.array(poles))
    upper = sorted((p for p in z if p.imag > 1e-12), key=lambda p: abs(p))
    real = sorted((p.real for p in z if abs(p.imag) <= 1e-12))
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    sections = np.array([[1.0, 0.0, -1.0, a1, a2] for a1, a2 in pairs])
    # unit gain at the band's centre
    at = np.exp(2j * np.pi * (math.atan(centre / (2 * fs)) * fs / np.pi) / fs)
    gain = np.prod([abs((1 - at**-2) / (1 + a1 / at + a2 / at**2)) for a1, a2 in pairs])
    sections[0, :3] /= gain
    return sections


def _sections(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Run the cascade over the last axis, started in the steady state of the first sample."""
    scale = x[:, 0].copy()
    for b0, b1, b2, a1, a2 in sections:
        steady = (b0 + b1 + b2) / (1 + a1 + a2)
        s1, s2 = (steady - b0) * scale, (b2 - a2 * steady) * scale
        out = np.empty_like(x)
        for i in range(x.shape[1]):
            out[:, i] = b0 * x[:, i] + s1
            s1 = b1 * x[:, i] - a1 * out[:, i] + s2
            s2 = b2 * x[:, i] - a2 * out[:, i]
        x, scale = out, scale * steady
    return x


def bandpass(x: np.ndarray, fs: float, low: float = 0.5, high: float = 40.0, order: int = 4) -> np.ndarray:
    """Zero-phase band-pass: forward and backward over an odd extension."""
    sections = butterworth(order, low, high, fs)
    pad = min(3 * len(sections), x.shape[1] - 1)
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = _sections(np.concatenate([left, x, right], axis=1), sections)
    y = _sections(y[:, ::-1], sections)[:, ::-1]
    return y[:, pad : pad + x.shape[1]]


def morphology(x: np.ndarray, fs: float, half: float = 0.06) -> dict[str, np.ndarray]:
    """Signed peak, width above 30 % of it in ms, and the share of energy near it."""
    rows, size = np.arange(len(x)), x.shape[1]
    at = np.abs(x).argmax(axis=1)
    above = np.abs(x) >= 0.3 * np.abs(x[rows, at])[:, None]
    first, last = above.argmax(axis=1), size - 1 - above[:, ::-1].argmax(axis=1)
    w = int(half * fs)
    i = np.arange(size)
    near = (i >= at[:, None] - w) & (i < at[:, None] + w)
    return {"r_amp": x[rows, at], "qrs_ms": (last - first) / fs * 1000.0, "energy_ratio": (x**2 * near).sum(axis=1) / ((x**2).sum(axis=1) + 1e-12)}


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling with a Kaiser-windowed (beta 5) low-pass."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.copy()
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / most) / most * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-x.shape[1] * up // down)
    out = np.zeros((len(x), n))
    for k in range(n):  # y[k] = sum of x[i] * h[k * down - i * up]
        centre = k * down
        i = np.arange(max(0, -(-(centre - half) // up)), min(x.shape[1] - 1, (centre + half) // up) + 1)
        out[:, k] = x[:, i] @ taps[centre - i * up + half]
    return out


def ratio(up: int, down: int) -> tuple[int, int]:
    g = math.gcd(up, down)
    return up // g, down // g


def resample_span(x: np.ndarray, lo: int, total: int, up: int, down: int, first: int, end: int) -> np.ndarray:
    """Values first .. end of ``resample`` of a signal of ``total`` samples, of which x holds those from lo on that they need."""
    most = max(up, down)
    half = 10 * most
    taps = np.sinc(np.arange(-half, half + 1) / most) / most * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    out = np.zeros(max(end - first, 0))
    for a in range(0, len(out), 8192):
        centre = np.arange(first + a, min(first + a + 8192, end)) * down
        i = -((half - centre) // up)[:, None] + np.arange(2 * half // up + 1)
        tap = centre[:, None] - i * up + half
        there = (tap >= 0) & (tap <= 2 * half) & (i >= 0) & (i < total)
        out[a : a + len(centre)] = (np.where(there, x[np.clip(i - lo, 0, len(x) - 1)], 0.0) * taps[np.clip(tap, 0, 2 * half)]).sum(axis=1)
    return out


def similarity_graph(window: np.ndarray, tau: float) -> np.ndarray:
    """Weights max(0, cosine) * exp(-|i - j| / tau) of a batch of windows (rows, nodes, values); no loops."""
    unit = window / (np.linalg.norm(window, axis=2, keepdims=True) + 1e-12)
    w = np.maximum(unit @ unit.transpose(0, 2, 1), 0)
    i = np.arange(window.shape[1])
    w = w * np.exp(-np.abs(i[:, None] - i[None, :]) / tau)
    w[:, i, i] = 0
    return w


def clustering(w: np.ndarray, node: int) -> np.ndarray:
    """Weighted clustering of one node: geometric means of triangle weights relative to the largest weight."""
    top = w.max(axis=(1, 2), keepdims=True)
    c = np.cbrt(np.divide(w, top, out=np.zeros_like(w), where=top > 0))
    own = c[:, node, :]
    triangles = np.einsum("ri,rij,rj->r", own, c, own)
    degree = (w[:, node, :] > 0).sum(axis=1)
    return np.divide(triangles, degree * (degree - 1), out=np.zeros(len(w)), where=degree > 1)


def pagerank(w: np.ndarray, alpha: float = 0.85, tol: float = 1e-6, most: int = 100) -> np.ndarray:
    """Weighted PageRank by power iteration; zeros where it does not settle."""
    n = w.shape[1]
    out = w.sum(axis=2, keepdims=True)
    step = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    loose = (out[:, :, 0] == 0).astype(float)
    rank = np.full(w.shape[:2], 1.0 / n)
    done = np.zeros(len(w), dtype=bool)
    for _ in range(most):
        new = alpha * (np.einsum("ri,rij->rj", rank, step) + (rank * loose).sum(axis=1, keepdims=True) / n) + (1 - alpha) / n
        close = np.abs(new - rank).sum(axis=1) < n * tol
        rank = np.where(done[:, None], rank, new)
        done |= close
        if done.all():
            break
    return np.where(done[:, None], rank, 0.0)
