"""Places of projected maps as longitude and latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid's half axis and flattening (WGS 84; that of ETRS 89 differs by a tenth of a millimetre), and the projection's scale and false origin.
AXIS, FLAT, SCALE, EAST_0, SOUTH_0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def utm_zone(code: int) -> tuple[int, bool]:
    """(zone, whether south) of an EPSG code of a universal transverse Mercator map."""
    for first, last, south in ((32601, 32660, False), (32701, 32760, True), (25828, 25838, False)):
        if first <= code <= last:
            return code - first + (28 if first == 25828 else 1), south
    raise ValueError(f"EPSG:{code} is not read here; there are 4326, 25828 to 25838, 32601 to 32660 and 32701 to 32760")


def lon_lat(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    """Degrees of a place in the coordinates of an EPSG code: as they are for 4326, else by the inverse of the transverse Mercator map.

    Krueger's series to the fourth power of the third flattening: to the sphere of equal meridian arcs, back along the
    transverse map, and from the conformal latitude to the geographic one by its own series.
    """
    if code == 4326:
        return x, y
    zone, south = utm_zone(code)
    n = FLAT / (2 - FLAT)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi, eta = (y - (SOUTH_0 if south else 0.0)) / (SCALE * radius), (x - EAST_0) / (SCALE * radius)
    xi_0, eta_0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi_0 = xi_0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_0 = eta_0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_0) / F.cosh(eta_0))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = math.radians(6 * zone - 183) + F.atan2(F.sinh(eta_0), F.cos(xi_0))
    return F.degrees(lon), F.degrees(lat)
