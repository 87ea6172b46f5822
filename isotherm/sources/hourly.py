"""Hourly grid readings in Parquet, partitioned by tile and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_hourly(df: DataFrame, path: str, tile: str = "tile_id") -> None:
    (
        df.withColumn("year", F.year("ts"))
        .repartitionByRange(tile, "year", "ts")
        .sortWithinPartitions("cell_key", "ts")
        .write.mode("overwrite")
        .partitionBy(tile, "year")
        .parquet(path)
    )


def read_hourly(spark: SparkSession, path: str, first_year: int, last_year: int, tiles: DataFrame | None = None) -> DataFrame:
    """A span of whole years with one day of halo at both ends.

    The halo lets a local day at the edge of the span be complete; the year filter prunes
    partitions, and ``tiles`` prunes by tile at run time.
    """
    start = F.lit(f"{first_year - 1}-12-31 00:00:00").cast("timestamp_ntz")
    stop = F.lit(f"{last_year + 1}-01-01 23:00:00").cast("timestamp_ntz")
    rows = spark.read.parquet(path).where(
        F.col("year").between(first_year - 1, last_year + 1) & F.col("ts").between(start, stop)
    )
    return rows if tiles is None else rows.join(tiles, tiles.columns, "left_semi")
