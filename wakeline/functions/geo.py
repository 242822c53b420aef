"""Geodesy as column expressions; angles in degrees, distances in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEG_LON, KM_PER_DEG_LAT = 111.32, 110.54


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def wrap180(angle: Column) -> Column:
    """Into [-180, 180); the remainder is floored, as angles need. Each step rounds as it does in SQL, to the last bit."""
    return ((angle + 180.0) % 360.0 + 360.0) % 360.0 - 180.0


def axis_difference(a: Column, b: Column) -> Column:
    """Between undirected axes: 0 to 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def flow_to_deg(u: Column, v: Column) -> Column:
    """Compass bearing that a flow (u east, v north) goes to."""
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def wind_from_deg(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(u, v)) + 180.0, F.lit(360.0))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth distance about the first point."""
    return F.hypot((lon2 - lon1) * KM_PER_DEG_LON * F.cos(F.radians(lat1)), (lat2 - lat1) * KM_PER_DEG_LAT)


def dead_reckoned(lat: Column, lon: Column, course: Column, knots: Column, hours: Column) -> tuple[Column, Column]:
    """(lat, lon) after sailing on."""
    km = knots * 1.852 * hours
    return lat + km * F.cos(F.radians(course)) / KM_PER_DEG_LAT, lon + km * F.sin(F.radians(course)) / (KM_PER_DEG_LON * F.cos(F.radians(lat)))


def laea_forward(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area coordinates (x, y) about a centre."""
    p, p0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    k = F.sqrt(F.lit(2.0) / (1.0 + F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)))
    return EARTH_KM * k * F.cos(p) * F.sin(d), EARTH_KM * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))


def laea_inverse(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    p0, r = F.radians(lat0), F.hypot(x, y)
    c = 2.0 * F.asin(F.least(F.lit(1.0), r / (2 * EARTH_KM)))
    lat = F.when(r == 0, lat0).otherwise(F.degrees(F.asin(F.cos(c) * F.sin(p0) + y * F.sin(c) * F.cos(p0) / r)))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), r * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c)))
    return lat, F.when(r == 0, lon0).otherwise(lon)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(per degree of latitude, per degree of longitude) on the WGS84 ellipsoid."""
    a, e2 = 6378137.0, 0.00669437999014
    w = 1.0 - e2 * F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    quarter = F.lit(3.141592653589793 / 180.0)
    return quarter * a * (1 - e2) / F.pow(w, F.lit(1.5)), quarter * a * F.cos(F.radians(lat)) / F.sqrt(w)
