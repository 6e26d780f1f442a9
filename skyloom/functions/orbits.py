"""Orbits and the sky as column expressions, from published formulas.

They are approximations: two-body motion with the secular effect of the Earth's flattening (J2),
mean sidereal time, and a Sun good to about a hundredth of a degree. A simulator that integrates
forces will differ. Angles are degrees, distances km, times seconds since 1970 UTC unless stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's gravity in km³/s², equatorial radius in km and J2 (fixed values, WGS-84).
MU = 398600.4418
RADIUS_KM = 6378.137
J2 = 1.08262668e-3
_J2000 = 946_728_000  # 2000-01-01 12:00 UTC


def sidereal_angle(at: Column) -> Column:
    """Greenwich mean sidereal time, 0…360."""
    days = (at - _J2000) / 86_400.0
    return F.pmod(280.46061837 + 360.98564736629 * days, F.lit(360.0))


def solve_kepler(mean_anomaly: Column, eccentricity: Column, rounds: int = 8) -> Column:
    """The eccentric anomaly in radians, by Newton's method with a fixed number of rounds."""
    step = lambda e, _: e - (e - eccentricity * F.sin(e) - mean_anomaly) / (1 - eccentricity * F.cos(e))
    # a fold, as nested expressions would triple with every round
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), mean_anomaly.cast("double"), step)


def propagate_j2(a: Column, e: Column, inclination: Column, node: Column, perigee: Column, mean: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """Inertial x, y, z after ``seconds``, from the elements at the epoch; node, perigee and mean anomaly drift with J2."""
    i = F.radians(inclination)
    n = F.sqrt(MU / (a * a * a))
    p = a * (1 - e * e)
    rate = 1.5 * J2 * n * (RADIUS_KM / p) * (RADIUS_KM / p)
    node_now = F.radians(node) - rate * F.cos(i) * seconds
    perigee_now = F.radians(perigee) + rate * (2 - 2.5 * F.sin(i) * F.sin(i)) * seconds
    mean_now = F.radians(mean) + (n + rate * F.sqrt(1 - e * e) * (1 - 1.5 * F.sin(i) * F.sin(i))) * seconds
    turn = 2 * math.pi
    anomaly = solve_kepler(F.pmod(mean_now, F.lit(turn)), e)
    u = perigee_now + 2 * F.atan2(F.sqrt(1 + e) * F.sin(anomaly / 2), F.sqrt(1 - e) * F.cos(anomaly / 2))
    r = a * (1 - e * F.cos(anomaly))
    return (
        r * (F.cos(node_now) * F.cos(u) - F.sin(node_now) * F.sin(u) * F.cos(i)),
        r * (F.sin(node_now) * F.cos(u) + F.cos(node_now) * F.sin(u) * F.cos(i)),
        r * F.sin(u) * F.sin(i),
    )


def inertial_to_fixed(x: Column, y: Column, z: Column, at: Column) -> tuple[Column, Column, Column]:
    """Earth-fixed x, y, z of an inertial place: a turn by the sidereal angle."""
    angle = F.radians(sidereal_angle(at))
    return F.cos(angle) * x + F.sin(angle) * y, F.cos(angle) * y - F.sin(angle) * x, z


def azimuth_elevation_range(lat: Column, lon: Column, site: tuple[Column, Column, Column], place: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Azimuth (0…360 from north), elevation and range of a place seen from a site, both Earth-fixed."""
    dx, dy, dz = (p - s for p, s in zip(place, site, strict=True))
    la, lo = F.radians(lat), F.radians(lon)
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    up = F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz
    reach = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up / reach)))), reach


def sun_direction(at: Column) -> tuple[Column, Column, Column]:
    """The inertial unit vector to the Sun (low-precision almanac formula)."""
    days = (at - _J2000) / 86_400.0
    mean = F.radians(357.528 + 0.9856003 * days)
    longitude = F.radians(280.460 + 0.9856474 * days + 1.915 * F.sin(mean) + 0.020 * F.sin(2 * mean))
    tilt = F.radians(23.439 - 0.0000004 * days)
    return F.cos(longitude), F.cos(tilt) * F.sin(longitude), F.sin(tilt) * F.sin(longitude)


def beta_angle(inclination: Column, node: Column, at: Column) -> Column:
    """The angle between the Sun and the plane of an orbit, -90…90."""
    i, o = F.radians(inclination), F.radians(node)
    x, y, z = sun_direction(at)
    return F.degrees(F.asin(F.sin(o) * F.sin(i) * x - F.cos(o) * F.sin(i) * y + F.cos(i) * z))


def line_of_sight(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], radius_km: float = RADIUS_KM) -> Column:
    """Whether the Earth doesn't stand between two places of one frame."""
    d = [q - p for p, q in zip(a, b, strict=True)]
    length2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    along = -(a[0] * d[0] + a[1] * d[1] + a[2] * d[2]) / F.nullif(length2, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    near = [p + t * q for p, q in zip(a, d, strict=True)]
    inside = near[0] * near[0] + near[1] * near[1] + near[2] * near[2] < radius_km * radius_km
    return ~(inside & (t > 0) & (t < 1))


def sunlit(place: tuple[Column, Column, Column], at: Column) -> Column:
    """Whether an inertial place is outside the Earth's cylindrical shadow."""
    sun = sun_direction(at)
    along = sum((p * s for p, s in zip(place[1:], sun[1:], strict=True)), place[0] * sun[0])
    size2 = sum((p * p for p in place[1:]), place[0] * place[0])
    return (along >= 0) | (size2 - along * along > RADIUS_KM * RADIUS_KM)


def off_axis_angle(axis: tuple[Column, Column, Column], view: tuple[Column, Column, Column]) -> Column:
    """The angle between two directions."""
    dot = sum((p * q for p, q in zip(axis[1:], view[1:], strict=True)), axis[0] * view[0])
    sizes = [F.sqrt(sum((p * p for p in v[1:]), v[0] * v[0])) for v in (axis, view)]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(sizes[0] * sizes[1], F.lit(0.0))))))
