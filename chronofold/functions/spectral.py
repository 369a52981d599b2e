"""Spectral kernels in NumPy, applied to whole Arrow batches; Spark has no Fourier transform.

A kernel takes stacked windows (rows, samples) of one length.  `vectorized` groups the rows of a batch by length, so
ragged columns work; a null window gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kernel, returns: str = "array<double>"):
    """A pandas UDF around a kernel."""

    def run(*columns: pd.Series) -> pd.Series:
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(zip(*columns, strict=True)):
            if all(v is not None for v in row):
                groups.setdefault(tuple(np.size(v) for v in row), []).append(i)
        out = np.empty(len(columns[0]), dtype=object)
        for at in groups.values():
            found = kernel(*(np.stack([np.asarray(c.iloc[i], dtype=float) for i in at]) for c in columns))
            for i, v in zip(at, found, strict=True):
                out[i] = v.tolist()
        return pd.Series(out)

    return F.pandas_udf(run, returns)


def interpolated(at: np.ndarray, grid: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Linear interpolation of each row of `values` on one grid, clamped outside."""
    k = np.clip(np.searchsorted(grid, at) - 1, 0, len(grid) - 2)
    share = np.clip((at - grid[k]) / (grid[k + 1] - grid[k]), 0, 1)
    return values[..., k] * (1 - share) + values[..., k + 1] * share


def framed(x: np.ndarray, width: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, width, axis=-1)[..., ::step, :]


def welch(x: np.ndarray, rate: float, width: int, overlap: int | None = None, mode: str = "mean") -> np.ndarray:
    """One-sided power density of Hann frames of the window without its mean."""
    step = width - (width // 2 if overlap is None else overlap)
    hann = np.hanning(width)
    power = np.abs(np.fft.rfft(framed(x - x.mean(-1, keepdims=True), width, step) * hann)) ** 2 / (hann**2).sum()
    power = np.median(power, -2) if mode == "median" else power.mean(-2)
    power[..., 1:-1] *= 2
    return power / rate


def fir(transfer: np.ndarray, taps: int, corner: int = 0) -> np.ndarray:
    """Impulse response of a one-sided transfer function: corner removed, soft edges, Hann truncation, centred."""
    soft = 1 / (np.exp(-np.arange(5) / 4) + 1)
    hard = 1 / (np.exp(np.arange(5) / 4) + 1)
    shaped = transfer.copy()
    shaped[..., :corner] = 0
    shaped[..., corner : corner + 5] *= soft
    shaped[..., -5:] *= hard
    response, half, hann = np.fft.irfft(shaped), taps // 2, np.hanning(taps)
    kept = np.zeros_like(response)
    kept[..., :half] = response[..., :half] * hann[half:]
    kept[..., -half:] = response[..., -half:] * hann[:half]
    return np.roll(kept, half - 1, axis=-1)[..., :taps]


def convolved(x: np.ndarray, taps: np.ndarray, mode: str = "same") -> np.ndarray:
    """FFT convolution; `same` and `valid` crop the full one at its centre."""
    n, m = x.shape[-1], taps.shape[-1]
    full = n + m - 1
    y = np.fft.irfft(np.fft.rfft(x, full) * np.fft.rfft(taps, full), full)
    size = {"full": full, "same": n, "valid": max(n, m) - min(n, m) + 1}[mode]
    start = (full - size) // 2
    return y[..., start : start + size]


def tapered_convolution(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """`same` convolution after both ends are faded with halves of a Hann window."""
    m = taps.shape[-1]
    pad, hann, y = -(-m // 2), np.hanning(m), x.copy()
    y[..., :pad] *= hann[:pad]
    y[..., -pad:] *= hann[-pad:]
    return convolved(y, taps)


def whitening(x: np.ndarray, background: np.ndarray, rate: float, highpass: float | None = None, seconds: float = 1.0) -> np.ndarray:
    """The window filtered by the inverse amplitude density of its background, near unit variance."""
    n = int(rate * seconds)
    density = np.sqrt(np.maximum(welch(background, rate, n, n // 2), 0))
    bins = np.arange(x.shape[-1] // 2 + 1) * rate / x.shape[-1]
    asd = np.maximum(interpolated(bins, np.arange(n // 2 + 1) * rate / n, density), 1e-8)
    taps = n - n % 2
    corner = int(highpass / (rate / x.shape[-1])) if highpass else 0
    return tapered_convolution(x, fir(1 / asd, taps, corner)) * np.sqrt(2 / rate)


def injection_snr(x: np.ndarray, background: np.ndarray, rate: float, width: int, overlap: int, low: float = 20.0) -> np.ndarray:
    """Optimal signal-to-noise ratio of a signal in its background, between `low` and the Nyquist frequency."""
    n = x.shape[-1]
    bins = np.arange(1, n // 2 + 1) * rate / n
    power = np.abs(np.fft.rfft(x)[..., 1:] / rate) ** 2
    noise = interpolated(bins, np.arange(width // 2 + 1) * rate / width, welch(background, rate, width, overlap))
    a, b = np.abs(bins - low).argmin(), np.abs(bins - int(rate / 2)).argmin()
    found = np.sqrt(4 * rate / n * (power / (noise + 1e-10))[..., a:b].sum(-1))
    return np.where(np.isinf(found), 0.0, found)


def power_frames(x: np.ndarray, width: int = 256, step: int = 128) -> np.ndarray:
    return np.abs(np.fft.rfft(framed(x, width, step) * np.hanning(width))) ** 2


def resampling(x: np.ndarray, ratio: float) -> np.ndarray:
    """Change of rate by cutting or padding the spectrum; an even number of samples comes out."""
    n = round(x.shape[-1] * ratio)
    n -= n % 2
    spectrum = np.fft.rfft(x)[..., : n // 2 + 1]
    return np.fft.irfft(spectrum, n) * (n / x.shape[-1])


def template_sigma(h: np.ndarray, rate: float, density: np.ndarray | float = 1.0) -> np.ndarray:
    """Optimal ratio of a template: the norm that matched filtering divides by."""
    power = np.abs(np.fft.rfft(h) / rate) ** 2 / np.maximum(density, 1e-50)
    return np.maximum(np.sqrt(4 * rate / h.shape[-1] * power.sum(-1)), 1e-50)


def filter_series(d: np.ndarray, h: np.ndarray, rate: float, density: np.ndarray | float = 1.0) -> np.ndarray:
    """Absolute matched-filter ratio at each sample; `density` is on the transform's bins."""
    c = np.fft.irfft(np.fft.rfft(d) * np.conj(np.fft.rfft(h)) / rate**2 / np.maximum(density, 1e-50), d.shape[-1])
    return np.abs(2 * rate * c / template_sigma(h, rate, density)[..., None])


def delayed(x: np.ndarray, seconds: np.ndarray, rate: float, taper: int = 16) -> np.ndarray:
    """Each row later by its own fraction of samples; wrapped samples are faded out."""
    n, tau = x.shape[-1], np.asarray(seconds, dtype=float)[..., None]
    ramp = np.exp(-2j * np.pi * np.arange(n // 2 + 1) * rate / n * tau)
    inside = np.minimum(np.arange(n) - np.ceil(tau * rate), np.floor(n + tau * rate) - np.arange(n))
    return np.fft.irfft(np.fft.rfft(x) * ramp, n) * np.sin(np.pi / 2 * np.clip(inside, 0, taper) / taper) ** 2


def coloured(white: np.ndarray, rate: float, frequencies: np.ndarray, density: np.ndarray) -> np.ndarray:
    """White noise shaped by amplitude densities, one row for all or one for each window."""
    n = white.shape[-1]
    asd = interpolated(np.arange(n // 2 + 1) * rate / n, np.asarray(frequencies, dtype=float), np.asarray(density, dtype=float))
    return np.fft.irfft(np.fft.rfft(white) * asd, n)


def burst(noise: np.ndarray, rate: float, duration: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Noise of a band and a duration under a centred Hann envelope; swapped bounds are put right."""
    n = noise.shape[-1]
    samples = np.minimum(np.floor(rate * duration), n)[..., None]
    k = np.arange(n) - (n - samples) // 2
    inside = (k >= 0) & (k < samples)
    bins = n // 2 + 1
    a, b = (np.round(f / (rate / 2) * bins)[..., None] for f in (np.minimum(low, high), np.maximum(low, high)))
    band = (np.arange(bins) >= a) & (np.arange(bins) <= b)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * k / np.maximum(samples - 1, 1))
    return np.fft.irfft(np.fft.rfft(noise * inside) * band, n) * np.where(inside, hann, 0)


def psd(x: Column, rate: float, width: int, overlap: int | None = None, mode: str = "mean") -> Column:
    return vectorized(lambda a: welch(a, rate, width, overlap, mode))(x)


def whitened(x: Column, background: Column, rate: float, highpass: float | None = None, seconds: float = 1.0) -> Column:
    return vectorized(lambda a, b: whitening(a, b, rate, highpass, seconds))(x, background)


def spectrogram(x: Column, width: int = 256, step: int = 128) -> Column:
    return vectorized(lambda a: power_frames(a, width, step), "array<array<double>>")(x)


def resampled(x: Column, ratio: float) -> Column:
    return vectorized(lambda a: resampling(a, ratio))(x)


def snr(x: Column, background: Column, rate: float, width: int, overlap: int, low: float = 20.0) -> Column:
    return vectorized(lambda a, b: injection_snr(a, b, rate, width, overlap, low), "double")(x, background)


def shifted(x: Column, seconds: Column, rate: float) -> Column:
    return vectorized(lambda a, t: delayed(a, t, rate))(x, seconds)


def pseudo_real(white: Column, real: Column, rate: float, width: int = 1024) -> Column:
    """White noise with the spectrum of a real window."""
    grid = np.arange(width // 2 + 1) * rate / width
    return vectorized(lambda a, b: coloured(a, rate, grid, np.sqrt(welch(b, rate, width))))(white, real)


def bursts(noise: Column, rate: float, duration: Column, low: Column, high: Column) -> Column:
    return vectorized(lambda a, d, lo, hi: burst(a, rate, d, lo, hi))(noise, duration, low, high)


def best_match(x: Column, templates: np.ndarray, rate: float) -> Column:
    """(snr, template, sample) of the largest matched-filter ratio over a bank given at plan time; first of equals."""
    bank = np.asarray(templates, dtype=float)

    def kernel(a):
        out = np.full((len(a), 3), -1.0)
        for t, h in enumerate(bank):
            series = filter_series(a, h, rate)
            top = series.max(-1)
            better = top > out[:, 0]
            out[better] = np.stack([top, np.full(len(a), float(t)), series.argmax(-1).astype(float)], 1)[better]
        return out

    return vectorized(kernel)(x)
