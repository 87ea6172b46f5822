"""Distances, grid keys and tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isotherm.functions.rounding import no_negative_zero

# The two Earth radii in use (site and study).
EARTH_KM = 6371.0
EARTH_KM_STUDY = 6371.0088
KM_PER_DEGREE = 111.0

# A tile is 50 x 100 grid steps of 0.1 degrees, counted from 90N 0E.
GRID_STEP = 0.1
TILE_ROWS = 50
TILE_COLS = 100

WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def projected_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Distance in the equirectangular plane where x = lon * cos(lat)."""
    dx = F.radians(lon2) * F.cos(F.radians(lat2)) - F.radians(lon1) * F.cos(F.radians(lat1))
    dy = F.radians(lat2) - F.radians(lat1)
    return F.sqrt(dx * dx + dy * dy) * F.lit(radius)


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)


def wind_name(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """One of eight winds, seen from (lat0, lon0) towards (lat, lon)."""
    turn = F.radians(lon - lon0)
    east = F.sin(turn) * F.cos(F.radians(lat))
    north = F.cos(F.radians(lat0)) * F.sin(F.radians(lat)) - F.sin(F.radians(lat0)) * F.cos(
        F.radians(lat)
    ) * F.cos(turn)
    degrees = F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))
    names = F.array(*[F.lit(w) for w in WINDS])
    return F.element_at(names, (F.pmod(F.bround(degrees / 45, 0).cast("int"), F.lit(8)) + 1).cast("int"))


def cell_key(lat: Column, lon: Column) -> Column:
    """``{lat}_{lon}`` with one decimal and without a negative zero."""
    return F.format_string("%.1f_%.1f", no_negative_zero(lat), no_negative_zero(lon))


def tile(lat: Column, lon: Column) -> dict[str, Column]:
    """Row, column, id and north-west corner of the tile a grid point lies in."""
    row = F.floor(F.bround((F.lit(90.0) - lat) / GRID_STEP, 0) / TILE_ROWS)
    col = F.floor(F.bround(F.pmod(lon, F.lit(360.0)) / GRID_STEP, 0) / TILE_COLS)
    return {
        "tile_id": F.concat(row.cast("string"), F.lit("_"), col.cast("string")),
        "tile_lat": F.lit(90.0) - row * 5.0,
        "tile_lon": col * 10.0,
    }


def lon180(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def solar_offset(lon: Column) -> Column:
    """Whole hours the local sun runs ahead of UTC, half to even."""
    return F.bround(lon180(lon) / 15, 0).cast("int")
