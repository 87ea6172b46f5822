"""Hourly readings to complete local days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions.geo import solar_offset
from isotherm.functions.rounding import half_even

HOURS_PER_DAY = 24
RESET_HOUR = 1


def accumulation_day(ts: Column) -> Column:
    """The day an accumulated total belongs to; totals restart at 01:00."""
    return F.to_date(ts - F.expr(f"INTERVAL {RESET_HOUR} HOUR"))


def deaccumulate(df: DataFrame, key: str = "cell_key") -> DataFrame:
    """``tp_incr``: hourly rain from a total that restarts at 01:00.

    The total at the restart is the increment itself, so no hour needs a row of another
    accumulation day and the window holds at most 24 rows, however long the history.
    A step without a predecessor, and any negative step, counts as zero.
    """
    window = Window.partitionBy(key, accumulation_day(F.col("ts"))).orderBy("ts")
    step = F.when(F.hour("ts") == RESET_HOUR, F.col("tp")).otherwise(F.col("tp") - F.lag("tp").over(window))
    return df.withColumn("tp_incr", F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(0.0)))


def hourly_wind(df: DataFrame) -> DataFrame:
    """Wind speed from its components, hour by hour and before any aggregation."""
    return df.withColumn("wind", F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")))


def with_local_day(df: DataFrame, offset_hours: Column) -> DataFrame:
    return df.withColumn("local_date", F.to_date(F.col("ts") + F.make_dt_interval(hours=offset_hours)))


def local_offset(cells: DataFrame) -> DataFrame:
    return cells.withColumn("offset_h", solar_offset(F.col("lon")))


def daily_metrics(df: DataFrame, key: str = "cell_key", complete_only: bool = True) -> DataFrame:
    """Local-day maximum, minimum, rain total and top wind; partial days are dropped.

    Needs ``local_date``, ``t2m``, ``tp_incr`` and ``wind``; every aggregate combines
    before the one shuffle on cell and day.
    """
    daily = df.groupBy(key, F.col("local_date").alias("date")).agg(
        F.max("t2m").alias("_hi"),
        F.min("t2m").alias("_lo"),
        F.sum("tp_incr").alias("_rain"),
        F.max("wind").alias("_wind"),
        F.count(F.lit(1)).alias("hours"),
    )
    if complete_only:
        daily = daily.where(F.col("hours") == HOURS_PER_DAY)
    return daily.select(key, "date", *to_daily_units(), "hours")


def to_daily_units() -> list[Column]:
    """Kelvin to Celsius and metres to millimetres, three decimals, halves to even."""
    return [
        half_even(F.col("_hi") - 273.15, 3).alias("tmax_C"),
        half_even(F.col("_lo") - 273.15, 3).alias("tmin_C"),
        half_even(F.col("_rain") * 1000, 3).alias("precip_mm"),
        half_even(F.col("_wind"), 3).alias("wind_max_ms"),
    ]


def land_points(df: DataFrame, point: list[str]) -> DataFrame:
    """Grid points with at least one finite reading."""
    finite = F.col("t2m").isNotNull() & ~F.isnan("t2m")
    return df.groupBy(*point).agg(F.bool_or(finite).alias("land"))
