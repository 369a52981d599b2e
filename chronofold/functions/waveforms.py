"""Waveforms, envelopes and noise as higher-order expressions over sample numbers: no Python workers."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.arrays import bound

TWO_PI = 2 * math.pi

#: SI values of the gravitational constant, the speed of light and the solar mass.
G_SI, C_SI, SOLAR_SI = 6.6743e-11, 299792458.0, 1.988409870698051e30


def per_row(f: Callable[..., Column], *values: Column) -> Column:
    """f of columns that are computed once a row, not once a sample."""
    row = F.struct(*[v.alias(f"c{k}") for k, v in enumerate(values)])
    return bound(row, lambda r: f(*[r[f"c{k}"] for k in range(len(values))]))


def samples(n: int, value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: value(i.cast("double")))


def times(n: int, start: float, stop: float):
    """Time of a sample number on a grid that includes its end."""
    return lambda i: F.lit(start) + i * ((stop - start) / max(n - 1, 1))


def hann(n: int, first: Column, count: Column):
    """Value of a Hann window of `count` samples from `first` on, 0 outside."""
    inside = lambda i: (i >= first) & (i < first + count)
    return lambda i: F.when(inside(i), 0.5 - 0.5 * F.cos(TWO_PI * (i - first) / F.greatest(count - 1, F.lit(1)))).otherwise(0.0)


def _first(n: int, count: Column) -> Column:
    return F.floor((F.lit(n) - count) / 2)


def envelope(n: int, count: Column) -> Column:
    """A centred Hann window of `count` samples."""
    return per_row(lambda at, m: samples(n, hann(n, at, m)), _first(n, count), count)


def periodic(shape: str, n: int, seconds: float, frequency: Column, amplitude: Column, phase: Column, count: Column) -> Column:
    t = times(n, 0.0, seconds)

    def wave(f, a, p, at, m):
        turn = lambda i: f * t(i) + p / TWO_PI
        saw = lambda i: bound(turn(i), lambda x: 2 * (x - F.floor(x)) - 1)
        sine = lambda i: F.sin(TWO_PI * f * t(i) + p)
        value = {"sine": sine, "square": lambda i: F.signum(sine(i)), "sawtooth": saw, "triangle": lambda i: 2 * F.abs(saw(i)) - 1}[shape]
        return samples(n, lambda i: a * value(i) * hann(n, at, m)(i))

    return per_row(wave, frequency, amplitude, phase, _first(n, count), count)


def sine_gaussian(n: int, seconds: float, frequency: Column, quality: Column, amplitude: Column, phase: Column) -> Column:
    t, tau = times(n, -seconds / 2, seconds / 2), quality / (frequency * math.sqrt(2) * math.pi)
    return per_row(lambda w, p, a, d: samples(n, lambda i: a * F.sin(w * t(i) + p) * F.exp(-t(i) * t(i) / d)), TWO_PI * frequency, phase, amplitude, 2 * tau * tau)


def chirplet(n: int, seconds: float, start: Column, stop: Column, duration: Column, amplitude: Column, phase: Column, count: Column) -> Column:
    t = times(n, 0.0, seconds)
    wave = lambda f, k, a, p, at, m: samples(n, lambda i: a * F.sin(TWO_PI * (f * t(i) + 0.5 * k * t(i) * t(i)) + p) * hann(n, at, m)(i))
    return per_row(wave, start, (stop - start) / duration, amplitude, phase, _first(n, count), count)


def ringdown(n: int, seconds: float, frequency: Column, tau: Column, amplitude: Column, phase: Column) -> Column:
    t = times(n, 0.0, seconds)
    return per_row(lambda f, d, a, p: samples(n, lambda i: a * F.sin(TWO_PI * f * t(i) + p) * F.exp(-t(i) / d)), frequency, tau, amplitude, phase)


def _chirp_seconds(m1: Column, m2: Column) -> Column:
    """Chirp mass in seconds."""
    return F.pow(F.pow(m1 * m2, F.lit(3.0)) / (m1 + m2), F.lit(0.2)) * (G_SI * SOLAR_SI / C_SI**3)


def least_frequency(m1: Column, m2: Column, seconds: Column) -> Column:
    """Frequency at which an inspiral has `seconds` left, at least 1 Hz."""
    f = F.pow(seconds / 5.0, F.lit(-0.375)) * F.pow(_chirp_seconds(m1, m2), F.lit(-0.625)) / (8 * math.pi)
    return F.greatest(F.lit(1.0), f)


def inspiral_seconds(m1: Column, m2: Column, frequency: Column) -> Column:
    return 5.0 * F.pow(8 * math.pi * frequency * F.pow(_chirp_seconds(m1, m2), F.lit(0.625)), F.lit(-8 / 3))


def inspiral(n: int, rate: float, m1: Column, m2: Column, inclination: Column, merger: float = 0.9) -> Column:
    """Plus polarisation of a leading-order inspiral at unit distance (chirp mass in light seconds), 0 after the merger."""
    mc, end = _chirp_seconds(m1, m2), merger * n / rate
    left = lambda i: F.lit(end) - i / rate
    size = F.pow(mc, F.lit(1.25)) * (1 + F.cos(inclination) * F.cos(inclination)) / 2
    wave = lambda s, m, i: s * F.pow(5.0 / left(i), F.lit(0.25)) * F.cos(-2 * F.pow(left(i) / m, F.lit(0.625)))
    return per_row(lambda s, m: samples(n, lambda i: F.when(left(i) > 0, wave(s, m, i)).otherwise(0.0)), size, 5.0 * mc)


def white_noise(n: int, key: Column, salt: str) -> Column:
    """Standard normal samples by Box-Muller from md5(key:salt:i); equal on any partitioning."""

    def value(i):
        digits = F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt), i.cast("int").cast("string")))
        u, v = (F.conv(F.substring(digits, at, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) for at in (1, 14))
        return F.sqrt(-2 * F.ln(1 - u)) * F.cos(TWO_PI * v)

    return samples(n, value)
