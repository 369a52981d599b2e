"""Scalar expressions: keys, portable draws, mass arithmetic, detector masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IFOS = ("L1", "H1", "V1")


def gps_key(gps: Column) -> Column:
    """Centisecond key of a time."""
    return F.rint(gps * 100).cast("long")


def uniform(key: Column, salt: str) -> Column:
    """A draw in [0, 1) from 52 bits of md5(key:salt); the same on any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def split_name(u: Column, shares: dict[str, float]) -> Column:
    """Name of the share that a draw falls in; the last takes the rest."""
    names, edge, out = list(shares), 0.0, None
    for name in names[:-1]:
        edge += shares[name]
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def chirp_mass(m1: Column, m2: Column) -> Column:
    return F.pow(m1 * m2, F.lit(0.6)) / F.pow(m1 + m2, F.lit(0.2))


def source_type(m1: Column, m2: Column, limit: float = 3.0) -> Column:
    """BBH: both masses reach the limit; BNS: neither; NSBH: one."""
    heavy = (m1 >= limit).cast("int") + (m2 >= limit).cast("int")
    return F.when(heavy == 2, "BBH").when(heavy == 0, "BNS").when(heavy == 1, "NSBH")


def mask_of(ifos: Column) -> Column:
    """Bit mask of a list of detectors."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(IFOS))])
    place = F.array(*map(F.lit, IFOS))
    return F.aggregate(F.array_distinct(ifos), F.lit(0), lambda a, x: a + F.element_at(bits, F.array_position(place, x).cast("int")))


def ifos_of(mask: Column) -> Column:
    """Detectors of a bit mask, in order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(IFOS)]))


def detection_probability(snr: Column, threshold: float = 8.0, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-(snr - threshold) / temperature))
