"""Log-mel features of sound, as batches of numpy arithmetic inside pandas UDFs.

The mel scale is 1127 ln(1 + f / 700). Two presets: ``clip_examples`` (25 ms windows every 10 ms, 64 bands
from 125 to 7500 Hz, log of the magnitude plus 0.01, examples of 96 frames) and ``evaluation_mel``
(log of the power-like magnitude plus 1e-6, padded or cut to 128 frames).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """Whole windows of ``length`` samples every ``hop``; what is left over is dropped."""
    if len(x) < length:
        return np.zeros((0, length))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def hann(n: int) -> np.ndarray:
    """The periodic raised cosine."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def magnitudes(x: np.ndarray, length: int, hop: int, fft: int) -> np.ndarray:
    return np.abs(np.fft.rfft(framed(x, length, hop) * hann(length), fft))


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz, float) / 700.0)


def mel_matrix(bands: int, bins: int, rate: float, low: float, high: float) -> np.ndarray:
    """bins x bands triangular weights; the bin of frequency 0 has none."""
    if not 0 <= low < high <= rate / 2:
        raise ValueError("band edges outside the spectrum")
    at, edge = mel(np.linspace(0, rate / 2, bins)), np.linspace(mel(low), mel(high), bands + 2)
    rise = (at[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - at[:, None]) / (edge[2:] - edge[1:-1])
    out = np.maximum(0, np.minimum(rise, fall))
    out[0] = 0
    return out


def log_mel(x: np.ndarray, rate: int, window: float, hop: float, bands: int, low: float, high: float, offset: float, fft: int | None = None) -> np.ndarray:
    n, step = round(rate * window), round(rate * hop)
    fft = fft or 1 << (n - 1).bit_length()
    return np.log(magnitudes(x, n, step, fft) @ mel_matrix(bands, fft // 2 + 1, rate, low, high) + offset)


#: The low-pass filter of ``resampled``: zero crossings on either side, share of the band that passes, and the Kaiser window's shape.
CROSSINGS, ROLLOFF, BETA = 64, 0.9475937167399596, 14.769656459379492


def resampled(x: np.ndarray, rate: int, to: int, block: int = 2048) -> np.ndarray:
    """``x`` at another rate by a windowed sinc that ends at the lower half rate, so higher tones vanish instead of folding back.

    Each sample is the filter's sum over the ``x`` around its time; beyond its ends ``x`` is 0.
    """
    if rate == to or not len(x):
        return x
    scale = min(1.0, to / rate)
    half = int(np.ceil(CROSSINGS / scale))
    held = np.pad(np.asarray(x, float), half + 1)
    out = np.empty(len(x) * to // rate)
    for lo in range(0, len(out), block):
        t = np.arange(lo, min(lo + block, len(out))) * (rate / to)
        at = np.floor(t).astype(int)[:, None] + np.arange(-half, half + 2)
        u = (t[:, None] - at) * scale
        window = np.i0(BETA * np.sqrt(np.maximum(0.0, 1 - (u / CROSSINGS) ** 2))) / np.i0(BETA)
        weight = np.where(np.abs(u) <= CROSSINGS, ROLLOFF * np.sinc(ROLLOFF * u) * window, 0.0) * scale
        out[lo : lo + len(t)] = (held[at + half + 1] * weight).sum(1)
    return out


def examples(x: np.ndarray, rate: int) -> np.ndarray:
    """Non-overlapping examples of 96 frames x 64 bands; several channels are averaged."""
    x = x.mean(1) if x.ndim > 1 else x
    f = log_mel(resampled(x, rate, 16000), 16000, 0.025, 0.010, 64, 125.0, 7500.0, 0.01)
    n = len(f) // 96
    return f[: n * 96].reshape(n, 96, 64)


def padded(f: np.ndarray, frames: int = 128) -> np.ndarray:
    """Cut to the first frames, or the last one repeated."""
    if len(f) >= frames:
        return f[:frames]
    return np.pad(f, ((0, frames - len(f)), (0, 0)), mode="edge" if len(f) else "constant")


def masked(f: np.ndarray, seed: int, widest: int, axis: int) -> np.ndarray:
    """A stretch of frames (axis 0) or bands (axis 1), of a width of at most ``widest``, set to 0."""
    rng = np.random.default_rng(seed)
    width = int(rng.integers(0, min(widest, f.shape[axis]) + 1))
    at = int(rng.integers(0, f.shape[axis] - width + 1))
    out = f.copy()
    out[(slice(at, at + width), slice(None))[:: 1 - 2 * axis]] = 0.0
    return out


def clip_examples(samples: Column, rate: int) -> Column:
    """Examples of a column of sample arrays, flattened, as array<array<double>>."""

    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [e.ravel() for e in examples(np.asarray(v, float), rate)], na_action="ignore")

    return run(samples)


def evaluation_mel(samples: Column, rate: int, bands: int = 80, frames: int = 128, window: float = 0.02, hop: float = 0.01) -> Column:
    """frames x bands, flattened."""
    n = round(rate * window)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: padded(log_mel(np.asarray(v, float), rate, window, hop, bands, 0.0, rate / 2, 1e-6, 2 * (n // 2 + 1)), frames).ravel(), na_action="ignore")

    return run(samples)
