"""Rounding conventions. Three of them meet in this data and none is Spark's own ``round``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.bround(x * scale, 0) / scale


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, so -0.5 becomes 0 and 0.5 becomes 1."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def no_negative_zero(x: Column) -> Column:
    """-0.0 becomes 0.0; every other value is unchanged."""
    return x + F.lit(0.0)


def snap(coord: Column, mode: str = "half_up") -> Column:
    """Snap a coordinate to the 0.1 degree grid under either rounding convention."""
    if mode == "half_up":
        tenths = F.floor(coord * 10 + 0.5).cast("double")
    elif mode == "half_even":
        tenths = F.bround(coord * 10, 0)
    else:
        raise ValueError(f"unknown rounding mode {mode!r}")
    return no_negative_zero(tenths / 10.0)


def r6(x: Column) -> Column:
    """Six decimals, for values that two engines may add up in different orders."""
    return no_negative_zero(F.round(x.cast("double"), 6))
