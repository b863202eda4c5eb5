"""Distances and bearings on a sphere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    meters = 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))
    return F.when(h.isNotNull(), meters)


def metres_between(lat1, lon1, lat2, lon2):
    """``haversine_m`` for numbers and arrays."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(d) * F.cos(b)
    y = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return (F.degrees(F.atan2(x, y)) + 360) % 360


def reach_m(v1: Column, v2: Column, dt: Column) -> Column:
    """How far two clips may be apart: the faster speed, 10 km/h at least, over the time, plus 50 m."""
    speed = F.greatest(F.coalesce(v1, F.lit(0.0)), F.coalesce(v2, F.lit(0.0)), F.lit(10.0))
    return speed / 3.6 * F.greatest(F.lit(1.0), F.abs(dt)) + 50
