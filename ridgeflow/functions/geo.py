"""Column expressions of spherical and local plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the ellipsoid, metres.
EARTH_RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two positions in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * (half_lon * half_lon)
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(inside))


def local_x(anchor_lat: Column, anchor_lon: Column, lon: Column) -> Column:
    """Eastward metres from an anchor."""
    return EARTH_RADIUS_M * F.cos(F.radians(anchor_lat)) * F.radians(lon - anchor_lon)


def local_y(anchor_lat: Column, lat: Column) -> Column:
    """Northward metres from an anchor."""
    return EARTH_RADIUS_M * F.radians(lat - anchor_lat)


def foot_on_segment(
    lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, lat: Column, lon: Column
) -> tuple[Column, Column]:
    """(share along the segment in [0, 1], distance to its foot) in A's plane."""
    bx, by = local_x(lat_a, lon_a, lon_b), local_y(lat_a, lat_b)
    px, py = local_x(lat_a, lon_a, lon), local_y(lat_a, lat)
    square = bx * bx + by * by
    raw = F.when(square > 0, (px * bx + py * by) / square).otherwise(F.lit(0.0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    return share, F.hypot(px - share * bx, py - share * by)


def along_across(
    lat0: Column, lon0: Column, tx: Column, ty: Column, lat: Column, lon: Column
) -> tuple[Column, Column]:
    """Signed (along, lateral) metres of a position in the frame (origin, tangent).

    The tangent is a unit vector; lateral is positive on its left."""
    x, y = local_x(lat0, lon0, lon), local_y(lat0, lat)
    return x * tx + y * ty, y * tx - x * ty


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + share * (b - a)
