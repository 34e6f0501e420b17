"""Geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine); null when a coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    # Not least(chord, 1): that skips nulls and would place unknown points half a globe away.
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(chord > 1, 1.0).otherwise(chord)))


def point_distance_km(a: Column, b: Column) -> Column:
    return distance_km(a["lat"], a["lon"], b["lat"], b["lon"])


def zone_of(lat: Column, lon: Column) -> Column:
    """Coarse world zone of a coordinate; the order of the boxes decides overlaps."""
    return (
        F.when(lat.isNull() | lon.isNull(), F.lit(None).cast("string"))
        .when(lat.between(12, 42) & lon.between(34, 63), "Middle East")
        .when(lat.between(34, 72) & lon.between(-25, 45), "Europe")
        .when(lat.between(-36, 38) & lon.between(-20, 52), "Africa")
        .when(lon.between(-170, -30), "Americas")
        .when(((lon >= 129) & (lat <= 10)) | (lon <= -150), "Oceania")
        .when((lon > 45) & (lon <= 180), "Asia")
        .otherwise("Other")
    )


def grid_cell(lat: Column, lon: Column, nx: int, ny: int) -> Column:
    """Cell of an equirectangular world grid, ``struct<cx, cy>`` counted from the north-west."""
    x = F.floor((lon + 180.0) / 360.0 * nx)
    y = F.floor((90.0 - lat) / 180.0 * ny)

    def clamp(v: Column, n: int) -> Column:
        return F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")

    return F.struct(clamp(x, nx).alias("cx"), clamp(y, ny).alias("cy"))


def view_window(point: Column, radius_deg: Column) -> Column:
    """Window to show a place, [lon_min, lon_max, lat_min, lat_max].

    Six radii wide (24 to 150 degrees) and moved, not cut, to stay on the globe.
    """
    span = F.least(F.greatest(radius_deg * 6, F.lit(24.0)), F.lit(150.0))
    west = F.least(F.greatest(point["lon"] - span / 2, F.lit(-180.0)), 180.0 - span)
    south = F.least(F.greatest(point["lat"] - span / 2, F.lit(-85.0)), 85.0 - span)
    return F.array(west, west + span, south, south + span)


def area_box(place: Column) -> Column:
    """The source's real box when there is one, else the window around the place."""
    return F.coalesce(place["bbox"], view_window(place["point"], place["radius_deg"]))


def in_box(lat: Column, lon: Column, lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> Column:
    return lon.between(lon_min, lon_max) & lat.between(lat_min, lat_max)


def place_struct(name: Column, lat: Column, lon: Column, radius: Column, bbox: Column | None = None) -> Column:
    box = F.lit(None).cast("array<double>") if bbox is None else bbox
    return F.struct(
        name.cast("string").alias("name"),
        F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).alias("point"),
        radius.cast("double").alias("radius_deg"),
        box.alias("bbox"),
    )
