"""Distributions and schedules as expressions of portable draws."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
ACKLAM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
ACKLAM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def uniform_between(u: Column, low: float, high: float) -> Column:
    """Bounds in the wrong order collapse to the upper one."""
    return F.lit(float(min(low, high))) + u * (high - min(low, high))


def log_uniform(u: Column, low: float, high: float) -> Column:
    """Exponent uniform between `low` and `high`, to base 10."""
    return F.pow(F.lit(10.0), uniform_between(u, low, high))


def choice(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.least(F.floor(u * len(values)), F.lit(len(values) - 1)) + 1).cast("int"))


def power_of_two(u: Column, low: int, high: int) -> Column:
    """2 to a whole exponent from low to high, both included."""
    return F.pow(F.lit(2.0), F.least(F.floor(u * (high - low + 1)), F.lit(high - low)) + low)


def _horner(x: Column, terms) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def normal_quantile(p: Column) -> Column:
    tail = lambda q: _horner(q, ACKLAM_C) / (_horner(q, ACKLAM_D) * q + 1)
    q = p - 0.5
    centre = _horner(q * q, ACKLAM_A) * q / (_horner(q * q, ACKLAM_B) * (q * q) + 1)
    edge = 0.02425
    return F.when(p < edge, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - edge, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(centre)


def truncated_normal(u: Column, mean: float, std: float, low: float = -math.inf, high: float = math.inf) -> Column:
    """Inverse cumulative form; only the bounds need the normal integral, once at plan time."""
    a, b = (NormalDist().cdf((x - mean) / std) if math.isfinite(x) else float(x > 0) for x in (low, high))
    p = F.greatest(F.lit(a) + u * (b - a), F.lit(1e-300))
    return F.greatest(F.lit(low), F.least(F.lit(high), mean + std * normal_quantile(p)))


def progress(epoch: Column, epochs: int, schedule: str = "linear", custom=None) -> Column:
    """Share of a curriculum passed at an epoch; 0 with a single epoch.  `custom` maps (epoch, epochs) to a column."""
    if epochs <= 1:
        return F.lit(0.0)
    t = F.least(epoch / (epochs - 1), F.lit(1.0))
    forms = {"linear": lambda: t, "exponential": lambda: 1 - F.exp(-5 * t), "cosine": lambda: 0.5 * (1 - F.cos(math.pi * t)), "step": lambda: F.when(t < 0.5, 0.0).otherwise(1.0), "custom": lambda: custom(epoch, epochs)}
    return forms[schedule]()


def between(p: Column, start: float, stop: float) -> Column:
    return start + p * (stop - start)
