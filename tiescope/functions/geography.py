"""Distances on the sphere and map text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def distance_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle (haversine) distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def speed_kmh(metres: Column, seconds: Column) -> Column:
    return metres / seconds * 18 / 5


def valid_point(lng: Column, lat: Column) -> Column:
    """Both coordinates can be read as numbers."""
    return lng.try_cast("double").isNotNull() & lat.try_cast("double").isNotNull()


def point_geojson(lng: Column, lat: Column) -> Column:
    """GeoJSON text of a point, longitude first."""
    return F.to_json(F.struct(
        F.lit("Point").alias("type"),
        F.array(lng, lat).alias("coordinates")))


def hexagon(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the hexagon with edge ``size`` a point lies in, a corner pointing up.

    The fractional coordinates q, r and s = -q - r are rounded; the one that
    moved most follows from the other two, so their sum stays 0.
    """
    q = (x * F.lit(3 ** 0.5 / 3) - y / 3) / F.lit(size)
    r = y * F.lit(2 / 3) / F.lit(size)
    s = -q - r
    whole = [F.round(c) for c in (q, r, s)]
    off = [F.abs(a - c) for a, c in zip(whole, (q, r, s))]
    q_moves = (off[0] > off[1]) & (off[0] > off[2])
    r_moves = ~q_moves & (off[1] > off[2])
    return (F.when(q_moves, -whole[1] - whole[2]).otherwise(whole[0]).cast("bigint"),
            F.when(r_moves, -whole[0] - whole[2]).otherwise(whole[1]).cast("bigint"))
