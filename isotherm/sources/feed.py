"""Daily blocks from a weather feed: JSON with parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = (
    "STRUCT<latitude: DOUBLE, longitude: DOUBLE, elevation: DOUBLE, daily: STRUCT<time: ARRAY<STRING>, "
    "temperature_2m_max: ARRAY<DOUBLE>, temperature_2m_min: ARRAY<DOUBLE>, "
    "precipitation_sum: ARRAY<DOUBLE>, wind_speed_10m_max: ARRAY<DOUBLE>>>"
)
FIELDS = {
    "temperature_2m_max": "tmax_C",
    "temperature_2m_min": "tmin_C",
    "precipitation_sum": "precip_mm",
    "wind_speed_10m_max": "wind_max_ms",
}


def daily_to_rows(df: DataFrame, payload: Column) -> DataFrame:
    """One row per date; a field the block lacks, or a short array, gives null."""
    parsed = df.withColumn("_b", F.from_json(payload, BLOCK))
    arrays = [F.coalesce(F.col(f"_b.daily.{f}"), F.array()).alias(f) for f in FIELDS]
    zipped = F.arrays_zip(F.col("_b.daily.time").alias("time"), *arrays)
    keep = [c for c in df.columns]
    return (
        parsed.select(*keep, F.explode(zipped).alias("_r"))
        .where(F.col("_r.time").isNotNull())
        .select(
            *keep,
            F.to_date("_r.time").alias("date"),
            *[F.col(f"_r.{f}").alias(c) for f, c in FIELDS.items()],
        )
    )
