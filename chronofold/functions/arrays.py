"""Array (window) functions as higher-order expressions: no Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, even where f names it for each sample."""
    return F.get(F.transform(F.array(value), f), 0)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def root_sum_square(x: Column, rate: float) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)) / rate)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def detrended(x: Column) -> Column:
    return bound(x, lambda w: bound(mean(w), lambda m: F.transform(w, lambda v: v - m)))


def finite(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))


def decimated(x: Column, factor: int) -> Column:
    return F.filter(x, lambda v, i: i % factor == 0)


def centre_crop(x: Column, n: int) -> Column:
    return F.slice(x, F.floor((F.size(x) - n) / 2).cast("int") + 1, n)


def frames(x: Column, width: int, hop: int) -> Column:
    """Overlapping frames; a remainder shorter than a frame is dropped."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - width) / hop).cast("int")), lambda k: F.slice(x, k * hop + 1, width))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two windows; 0 where one is constant."""

    def of(a: Column, b: Column) -> Column:
        size = F.sqrt(total(F.transform(a, lambda v: v * v)) * total(F.transform(b, lambda v: v * v)))
        return bound(size, lambda n: F.when(n > 0, total(F.zip_with(a, b, lambda u, v: u * v)) / n).otherwise(0.0))

    return bound(detrended(x), lambda a: bound(detrended(y), lambda b: of(a, b)))


def scaled_to(x: Column, size: Column, target: float) -> Column:
    """The window times target / size; a window of size 0 stays 0."""
    return bound(target / (size + 1e-7), lambda k: F.transform(x, lambda v: v * k))


def rolled(x: Column, by: Column) -> Column:
    """Circular shift: the last `by` samples come first."""
    n = F.size(x)
    k = F.pmod(by, n)
    return F.concat(F.slice(x, n - k + 1, k), F.slice(x, F.lit(1), n - k))


def moved(x: Column, by: Column) -> Column:
    """Shift to the right with zeros in front (to the left with zeros behind, where negative)."""
    n = F.size(x)
    k = F.least(F.abs(by), n).cast("int")
    zeros = F.array_repeat(F.lit(0.0), k)
    return F.when(by >= 0, F.concat(zeros, F.slice(x, F.lit(1), n - k))).otherwise(F.concat(F.slice(x, k + 1, n - k), zeros))


def line_detrended(x: Column) -> Column:
    """The window without its least-squares line."""

    def of(w: Column) -> Column:
        n = F.size(w).cast("double")
        lean = total(F.transform(w, lambda v, i: v * (i - (n - 1) / 2))) / (n * (n * n - 1) / 12)
        line = F.struct(mean(w).alias("m"), lean.alias("k"), ((n - 1) / 2).alias("c"))
        return bound(line, lambda p: F.transform(w, lambda v, i: v - p["m"] - p["k"] * (i - p["c"])))

    return bound(x, of)


def around_centre(x: Column, on: int, off: int) -> Column:
    """(onsource, offsource) about the middle: offsource from before the window, edge-padded where short, else from
    after it; null where the samples do not reach."""
    n = F.size(x)
    start = F.floor(n / 2).cast("int") - on // 2
    end, tail = start + on, n - (start + on)
    before = F.when(start >= off, F.slice(x, F.greatest(start - off, F.lit(0)) + 1, off)).otherwise(F.concat(F.array_repeat(x[0], F.greatest(off - start, F.lit(0))), F.slice(x, F.lit(1), F.greatest(start, F.lit(0)))))
    after = F.when(tail >= off, F.slice(x, F.greatest(end, F.lit(0)) + 1, off)).otherwise(F.concat(F.slice(x, F.greatest(end, F.lit(0)) + 1, F.greatest(tail, F.lit(0))), F.array_repeat(F.element_at(x, -1), F.greatest(off - tail, F.lit(0)))))
    found = F.when(start > 0, before).when(tail > 0, after)
    return F.when((n >= on) & (start >= 0) & (tail >= 0) & found.isNotNull(), F.struct(F.slice(x, F.greatest(start, F.lit(0)) + 1, on).alias("onsource"), found.alias("offsource")))


def subsection(x: Column, u: Column, on: int, off: int, margin: int = 16) -> Column:
    """(start, onsource, offsource) at a drawn start in [off, n - on - margin); null where the window is too short."""
    room = F.size(x) - on - margin - off
    start = (off + F.least(F.floor(u * room), room - 1)).cast("int")
    s = F.greatest(start, F.lit(off))
    return F.when(room > 0, F.struct(s.alias("start"), F.slice(x, s + 1, on).alias("onsource"), F.slice(x, s - off + 1, off).alias("offsource")))


def rolling_pearson(x: Column, y: Column, reach: int) -> Column:
    """Correlation at each circular shift of y by reach, reach - 1, ..., 1 - reach samples."""

    def of(p: Column) -> Column:
        n = F.size(p["b"])
        at = lambda o: F.slice(p["twice"], F.pmod(-(F.lit(reach) - o), n) + 1, n)
        return F.transform(F.sequence(F.lit(0), F.lit(2 * reach - 1)), lambda o: total(F.zip_with(p["a"], at(o), lambda u, v: u * v)) / p["size"])

    def sized(a: Column, b: Column) -> Column:
        size = F.sqrt(total(F.transform(a, lambda v: v * v)) * total(F.transform(b, lambda v: v * v))) + 1e-5
        return bound(F.struct(a.alias("a"), b.alias("b"), F.concat(b, b).alias("twice"), size.alias("size")), of)

    return bound(detrended(x), lambda a: bound(detrended(y), lambda b: sized(a, b)))


def even(x: Column) -> Column:
    """The window without its last sample where their number is odd."""
    return F.slice(x, F.lit(1), F.size(x) - F.size(x) % 2)
