"""Detector networks: response tensors at plan time, antenna patterns and delays as trigonometric columns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.expressions import uniform

C_SI = 299792458.0

#: Longitude, latitude, angles of both arms (radians) and height (metres) of the three observatories.
SITES = {
    "L1": {"longitude_radians": -1.5843093707829257, "latitude_radians": 0.5334231350225018, "x_angle_radians": 4.403177738189697, "y_angle_radians": 2.8323814868927, "height_meters": -6.573999881744385},
    "H1": {"longitude_radians": -2.08405676916594, "latitude_radians": 0.810795263791696, "x_angle_radians": 5.654877185821533, "y_angle_radians": 4.084080696105957, "height_meters": 142.5540008544922},
    "V1": {"longitude_radians": 0.1833380521285067, "latitude_radians": 0.7615118398044829, "x_angle_radians": 0.3391628563404083, "y_angle_radians": 5.051551818847656, "height_meters": 51.88399887084961},
}


@dataclass(frozen=True)
class Detector:
    response: np.ndarray
    location: np.ndarray


def detector(longitude_radians: float, latitude_radians: float, y_angle_radians: float, x_angle_radians: float | None = None, height_meters: float = 0.0) -> Detector:
    """Response tensor in Earth-centred axes and place on the WGS-84 ellipsoid; arms are square by default."""
    lon, lat = longitude_radians, latitude_radians
    x = y_angle_radians + math.pi / 2 if x_angle_radians is None else x_angle_radians
    south = np.array([math.sin(lat) * math.cos(lon), math.sin(lat) * math.sin(lon), -math.cos(lat)])
    east = np.array([-math.sin(lon), math.cos(lon), 0.0])

    def arm(angle):
        """(v v' - w w') / 4 of the arm direction v and its horizontal normal w."""
        v = -math.cos(angle) * south + math.sin(angle) * east
        w = math.sin(angle) * south + math.cos(angle) * east
        return (np.outer(w, w) - np.outer(v, v)) / 4

    a, flat = 6378137.0, 1 / 298.257223563
    e2 = flat * (2 - flat)
    r = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    h = height_meters
    place = np.array([(r + h) * math.cos(lat) * math.cos(lon), (r + h) * math.cos(lat) * math.sin(lon), (r * (1 - e2) + h) * math.sin(lat)])
    return Detector(arm(y_angle_radians) - arm(x), place)


def network(sites: dict[str, dict]) -> dict[str, Detector]:
    return {name: detector(**site) for name, site in sites.items()}


def load_network(path: str) -> dict[str, Detector]:
    """A network from a JSON file of the same form as SITES."""
    with open(path, encoding="utf-8") as f:
        return network(json.load(f))


def longest_arrival_difference(detectors: dict[str, Detector], default: float = 0.01) -> float:
    """Largest distance between two detectors in light seconds; a network holds a handful."""
    places = [d.location for d in detectors.values()]
    found = [float(np.linalg.norm(a - b)) / C_SI for i, a in enumerate(places) for b in places[:i]]
    return max(found, default=default)


def _dot(v: list[Column], w) -> Column:
    return v[0] * w[0] + v[1] * w[1] + v[2] * w[2]


def delay(d: Detector, ra: Column, dec: Column) -> Column:
    """Seconds from the Earth's centre to a detector along a direction."""
    e = [F.cos(dec) * F.cos(ra), -F.cos(dec) * F.sin(ra), F.sin(dec)]
    return _dot(e, [float(x) for x in d.location]) / C_SI


def antenna(d: Detector, ra: Column, dec: Column, psi: Column) -> tuple[Column, Column]:
    """(plus, cross) response to a direction and polarisation."""
    x = [-F.cos(psi) * F.sin(ra) - F.sin(psi) * F.cos(ra) * F.sin(dec), -F.cos(psi) * F.cos(ra) + F.sin(psi) * F.sin(ra) * F.sin(dec), F.sin(psi) * F.cos(dec)]
    y = [F.sin(psi) * F.sin(ra) - F.cos(psi) * F.cos(ra) * F.sin(dec), F.sin(psi) * F.cos(ra) + F.cos(psi) * F.sin(ra) * F.sin(dec), F.cos(psi) * F.cos(dec)]
    rows = [[float(v) for v in row] for row in d.response]
    dx, dy = [_dot(x, row) for row in rows], [_dot(y, row) for row in rows]
    return _dot(x, dx) - _dot(y, dy), _dot(x, dy) + _dot(y, dx)


def sky(key: Column, salt: str) -> tuple[Column, Column]:
    """(right ascension, declination) uniform over the sphere."""
    return 2 * math.pi * uniform(key, salt + "a"), F.asin(2 * uniform(key, salt + "d") - 1)
