"""Display units, bin widths and axis padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors and the ladders of tidy bin widths.
MS_TO_KMH = 3.6
MS_TO_MPH = 2.2369362921
MM_PER_INCH = 25.4
MAX_BINS = 50
BIN_LADDERS = {
    ("temp", "metric"): (0.5, 1.0, 2.0, 5.0),
    ("temp", "imperial"): (1.0, 2.0, 5.0, 10.0),
    ("precip", "metric"): (1.0, 2.0, 5.0, 10.0),
    ("precip", "imperial"): (0.05, 0.1, 0.25, 0.5, 1.0),
    ("wind", "metric"): (1.0, 2.0, 5.0, 10.0),
    ("wind", "imperial"): (0.5, 1.0, 2.0, 5.0),
}


def _kind(metric: str) -> str:
    return "temp" if metric in ("tmax", "tmin") else metric


def convert(value: Column, metric: str, system: str) -> Column:
    """A reading in display units."""
    kind = _kind(metric)
    if kind == "temp" and system == "imperial":
        return value * 9 / 5 + 32
    return convert_delta(value, metric, system)


def convert_delta(value: Column, metric: str, system: str) -> Column:
    """A difference of two readings in display units: no offset."""
    kind = _kind(metric)
    if kind == "wind":
        return value * (MS_TO_MPH if system == "imperial" else MS_TO_KMH)
    if system == "metric":
        return value
    return value * 9 / 5 if kind == "temp" else value / MM_PER_INCH


def bin_width(metric: str, system: str, span: Column) -> Column:
    """The finest tidy width that needs at most 50 bins over the span."""
    ladder = BIN_LADDERS[(_kind(metric), system)]
    width = F.lit(ladder[-1])
    for step in reversed(ladder):
        width = F.when((span <= 0) | (span / step <= MAX_BINS), F.lit(step)).otherwise(width)
    return width


def axis_pad(metric: str, system: str, span: Column) -> Column:
    if _kind(metric) == "temp":
        return F.lit(2.0)
    floor = BIN_LADDERS[(_kind(metric), system)][0]
    return F.greatest(F.lit(floor), F.ceil(span * 0.15 / floor) * floor)
