"""Bands on rows: absolute values from deltas, and model values replaced by medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.rounding import half_up
from isotherm.operators.tiers import DAY
from isotherm.schemas import BAND_COLUMNS, DELTA_COLUMNS


def absolute(df: DataFrame, base: Column, nonneg: bool) -> DataFrame:
    """Nine band columns: base plus delta, a zero floor where one applies, three decimals."""
    heads = {}
    for delta, name in zip(DELTA_COLUMNS, BAND_COLUMNS):
        head = base + F.col(delta)
        heads[name] = half_up(F.greatest(F.lit(0.0), head) if nonneg else head, 3)
    return df.withColumns(heads).drop(*DELTA_COLUMNS)


def snap_to_median(days: DataFrame, bands: DataFrame, column: str, metric: str) -> DataFrame:
    """Model values become the band's median; measured values stay as they are.

    Forecast rows are model output in every metric, recent rows in rain and wind only.
    """
    model = F.col("tier") == "forecast"
    if metric in ("precip", "wind"):
        model = model | (F.col("tier") == "recent")
    joined = days.join(bands.select(*DAY, F.col("mid").alias("_mid")), list(DAY), "left")
    has_band = model & F.col("_mid").isNotNull()
    return (
        joined.withColumn("banded", has_band)
        .withColumn(column, F.when(has_band, F.col("_mid")).otherwise(F.col(column)))
        .drop("_mid")
    )
