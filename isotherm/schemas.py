"""The data model: explicit schemas and the metric table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

CELL_DAY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("tmax_C", T.DoubleType()),
        T.StructField("tmin_C", T.DoubleType()),
        T.StructField("precip_mm", T.DoubleType()),
        T.StructField("wind_max_ms", T.DoubleType()),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
        T.StructField("population", T.StringType()),
        T.StructField("tile_id", T.StringType()),
        T.StructField("tile_lat", T.StringType()),
        T.StructField("tile_lon", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)


class Metric(NamedTuple):
    """One daily metric: its short name, its column and whether it has a zero floor."""

    name: str
    column: str
    nonneg: bool


METRICS = (
    Metric("tmax", "tmax_C", False),
    Metric("tmin", "tmin_C", False),
    Metric("precip", "precip_mm", True),
    Metric("wind", "wind_max_ms", True),
)
VALUE_COLUMNS = [m.column for m in METRICS]

# The quantile levels of a band and the column names that carry them.
LEVELS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
BAND_COLUMNS = ("q01", "lo", "q10", "q25", "mid", "q75", "q90", "hi", "q99")
DELTA_COLUMNS = ("d01", "dlo", "d10", "d25", "dmid", "d75", "d90", "dhi", "d99")

# Fixed value: below this a day counts as dry everywhere.
TRACE_MM = 1.0

TIER_PRIORITY = {"archive": 0, "recent": 1, "forecast": 2}
