"""Geometry on the globe as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
#: WGS-84 (fixed values).
WGS84_A_M = 6378137.0
WGS84_F = 1 / 298.257223563


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km of two places in degrees."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * radius_km * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def ecef_m(lat: Column, lon: Column, alt_m: Column, digits: int | None = 5) -> tuple[Column, Column, Column]:
    """WGS-84 earth-fixed x, y, z in metres of a place in degrees and metres, rounded to ``digits``; None keeps them exact."""
    e2 = WGS84_F * (2 - WGS84_F)
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    normal = WGS84_A_M / F.sqrt(1 - e2 * sin * sin)
    axes = ((normal + alt_m) * cos * F.cos(F.radians(lon)), (normal + alt_m) * cos * F.sin(F.radians(lon)), (normal * (1 - e2) + alt_m) * sin)
    return tuple(_rounded(a, digits) for a in axes)


def distance3(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    """Straight distance of two points in the unit of their coordinates."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))


def ground_sample_distance(factor: float, range_km: Column, elevation_deg: Column, digits: int | None = 3) -> Column:
    """factor * range / sqrt(sin(elevation)), rounded to ``digits`` (None: exact); null at or below the horizon."""
    return F.when(elevation_deg > 0, _rounded(F.lit(factor) * range_km / F.sqrt(F.sin(F.radians(elevation_deg))), digits))


def nadir_sample_distance(factor: float, semi_major_km: Column, digits: int | None = 3) -> Column:
    """The ground sample distance straight down from a circular orbit, rounded to ``digits`` (None: exact)."""
    return _rounded(F.lit(factor) * (semi_major_km - EARTH_RADIUS_KM), digits)


def swath_width(x: Column, y: Column, z: Column, half_angle_deg: Column, digits: int | None = 2) -> Column:
    """(distance from the Earth's centre - 6371) * tan(half angle), in km, rounded to ``digits`` (None: exact)."""
    return _rounded((F.sqrt(x * x + y * y + z * z) - EARTH_RADIUS_KM) * F.tan(F.radians(half_angle_deg)), digits)


def local_solar_time(utc: Column, lon: Column) -> Column:
    """HH:mm of mean solar time at a longitude; a degree is four minutes."""
    shifted = F.timestamp_micros(F.unix_micros(utc) + F.round(lon * 240_000_000).cast("long"))
    return F.date_format(shifted, "HH:mm")


def connection_quality(distance: Column, nearest: float = 100_000.0, farthest: float = 10_000_000.0) -> Column:
    """0 to 100, falling linearly from ``nearest`` to ``farthest``, cut to a whole number."""
    raw = 100 * (1 - (distance - nearest) / (farthest - nearest))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int")))


def chord(km: float, radius_km: float = EARTH_RADIUS_KM) -> float:
    """The straight distance on the unit sphere that belongs to a great-circle distance."""
    return 2 * math.sin(min(km / (2 * radius_km), math.pi / 2))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """x, y, z on the unit sphere."""
    flat = F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def wrapped_longitude(lon: Column) -> Column:
    """The longitude in [-180, 180)."""
    return lon - 360 * F.floor((lon + 180) / 360)
