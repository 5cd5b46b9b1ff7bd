"""Great-circle distance and grid cells for proximity joins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.7613
MILES_PER_DEGREE = EARTH_RADIUS_MILES * math.pi / 180


def valid_coordinate(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_MILES) * 2 * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def longitude_reach(latitude: Column, degrees: float | Column) -> Column:
    """Degrees of longitude that a radius of ``degrees`` (of latitude) can span at a latitude."""
    reach = F.lit(degrees) if not isinstance(degrees, Column) else degrees
    edge = F.least(F.abs(latitude) + reach, F.lit(89.999999))
    return F.least(reach / F.cos(F.radians(edge)), F.lit(180.0))


def cells_within(latitude: Column, longitude: Column, degrees: float | Column, size: float) -> Column:
    """Array of (lat_cell, lon_cell) that a circle of ``degrees`` can touch; longitude wraps."""
    reach = F.lit(degrees) if not isinstance(degrees, Column) else degrees
    rows = F.sequence(cell(latitude - reach, size), cell(latitude + reach, size))
    span = longitude_reach(latitude, reach)
    lows, highs = longitude - span, longitude + span
    # What reaches over the date line is taken up on its other side, in the cells of the longitudes there.
    none = F.array().cast("array<int>")
    inner = F.sequence(cell(F.greatest(lows, F.lit(-180.0)), size), cell(F.least(highs, F.lit(180.0)), size))
    east = F.when(highs > 180, F.sequence(cell(F.lit(-180.0), size), cell(F.least(highs - 360, F.lit(180.0)), size))).otherwise(none)
    west = F.when(lows < -180, F.sequence(cell(F.greatest(lows + 360, F.lit(-180.0)), size), cell(F.lit(180.0), size))).otherwise(none)
    columns = F.array_distinct(F.concat(inner, east, west))
    return F.flatten(
        F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct(r.alias("lat_cell"), c.alias("lon_cell"))))
    )
