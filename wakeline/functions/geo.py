"""Distances, bearings and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from wakeline.constants import (
    EARTH_RADIUS_KM,
    MERCATOR_RADIUS_M,
    NM_TO_KM,
    PLANAR_KM_PER_DEG,
    SPAN_KM_PER_DEG,
)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle kilometres; the root argument is clipped to 1 for antipodes."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) / F.lit(NM_TO_KM)


def turn_deg(current, previous) -> Column:
    """Signed course change in [-180, 180); pmod is the floor modulo."""
    return F.pmod(current - previous + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def planar_km(dlat, dlon, lat) -> Column:
    """Local flat-earth distance for small offsets around `lat`."""
    north = dlat * F.lit(PLANAR_KM_PER_DEG)
    east = dlon * F.lit(PLANAR_KM_PER_DEG) * F.cos(F.radians(lat))
    return F.sqrt(north * north + east * east)


def initial_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.degrees(F.atan2(y, x))


def mercator_x(lon) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(lon)


def mercator_y(lat) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def degree_span(km, mid_lat) -> tuple[Column, Column]:
    """Latitude and longitude degrees that cover `km` around `mid_lat`."""
    per_lon = F.greatest(F.lit(SPAN_KM_PER_DEG) * F.cos(F.radians(mid_lat)), F.lit(1e-6))
    return km / F.lit(SPAN_KM_PER_DEG), km / per_lon


def in_box(lat, lon, bounds: tuple[float, float, float, float]) -> Column:
    """Inclusive box test with bounds (lat_min, lat_max, lon_min, lon_max)."""
    lat_min, lat_max, lon_min, lon_max = bounds
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)
