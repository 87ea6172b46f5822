"""Derived columns of the climate frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and class limits of the studies.
WET_MM = 1.0
DRY_MM = 0.1
BIG_MISS = 3.0
LAPSE_PER_M = 0.0065
CLIMATE_LIMITS = ((23.5, "Tropical"), (35.0, "Subtropical"), (55.0, "Mid-latitude"), (91.0, "High-latitude"))
ELEVATION_LIMITS = ((200.0, "Lowland"), (1000.0, "Upland"), (2500.0, "Highland"), (1e9, "Mountain"))


def to_number(text: Column) -> Column:
    """Blank or malformed text is null."""
    return F.trim(text).try_cast("double")


def _upto(value: Column, limits) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(value <= limit, name)
    return out


def climate_zone(lat: Column) -> Column:
    return _upto(F.abs(lat), CLIMATE_LIMITS)


def elevation_band(metres: Column) -> Column:
    return _upto(metres, ELEVATION_LIMITS)


def hemisphere(lat: Column) -> Column:
    return F.when(lat >= 0, "N").otherwise("S")


def log_population(people: Column) -> Column:
    return F.log10(F.greatest(people, F.lit(1)))


def lapse_corrected(diff: Column, elev_diff_m: Column) -> Column:
    return diff - F.lit(LAPSE_PER_M) * elev_diff_m


def clip(value: Column, limit: float) -> Column:
    return F.least(F.greatest(value, F.lit(-limit)), F.lit(limit))


def record_position(value: Column, low: Column, high: Column, bins: int = 10) -> Column:
    """Where a value sits between two records, as one of ``bins`` + 1 tidy fractions.

    With equal records there is a side but no position: 0 below, 1 above, half on them.
    """
    flat = F.when(value > high, 1.0).when(value < low, 0.0).otherwise(0.5)
    raw = F.when(high > low, (value - low) / (high - low)).otherwise(flat)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.floor(inside * bins + 0.5) / bins


def search_bin(edges: Column, value: Column) -> Column:
    """0-based bin of a value among sorted inner edges; a value on an edge is above it."""
    return F.size(F.filter(edges, lambda e: e <= value))


def right_closed_bin(edges: Column, value: Column) -> Column:
    """0-based bin of right-closed intervals over sorted edges, null outside them.

    The lowest edge itself is outside.
    """
    at = F.size(F.filter(edges, lambda e: e < value)) - 1
    return F.when((at >= 0) & (value <= F.element_at(edges, -1)), at)
