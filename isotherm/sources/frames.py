"""Materialised frames that refuse to be used when stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleFrame(RuntimeError):
    """A stored frame no longer agrees with how it would be built today."""


def store_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def staleness_report(frame: DataFrame, stored: str, expected: Column) -> DataFrame:
    """Rows and disagreements per stored value."""
    return frame.groupBy(stored).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(stored).eqNullSafe(expected)).alias("stale")
    )


def load_frame(spark: SparkSession, path: str, stored: str, expected: Column) -> DataFrame:
    """The stored frame, or ``StaleFrame`` if any row disagrees with ``expected``."""
    frame = spark.read.parquet(path)
    if not frame.where(~F.col(stored).eqNullSafe(expected)).isEmpty():
        raise StaleFrame(f"{path}: column {stored} is out of date; rebuild the frame")
    return frame
