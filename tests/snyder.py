"""Universal Transverse Mercator by another published series (Snyder, 1987), which the library's is held against."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# WGS 84 and the UTM projection
A, FLAT, K0, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)


def meridian_arc(phi: Column) -> Column:
    c0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
    c2 = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
    c4 = 15 * E2**2 / 256 + 45 * E2**3 / 1024
    c6 = 35 * E2**3 / 3072
    return A * (c0 * phi - c2 * F.sin(2 * phi) + c4 * F.sin(4 * phi) - c6 * F.sin(6 * phi))


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), EP2 * F.pow(F.cos(phi), 2), lam * F.cos(phi)
    x = n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, 5) / 120)
    y = n * F.tan(phi) * (F.pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, 6) / 720)
    return K0 * x + EASTING, K0 * (meridian_arc(phi) + y) + (NORTHING if south else 0.0)
