"""Cell list, gazetteer and lookup files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.schemas import CELLS


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cell list; rows whose coordinates are not finite numbers are dropped."""
    raw = spark.read.schema(CELLS).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    lat, lon = F.expr("try_cast(lat AS DOUBLE)"), F.expr("try_cast(lon AS DOUBLE)")
    finite = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return raw.where(finite & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))).select(
        F.expr("try_cast(cell_id AS BIGINT)").alias("cell_id"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.coalesce(F.expr("try_cast(population AS BIGINT)"), F.lit(0)).alias("population"),
        "tile_id",
        F.expr("try_cast(tile_lat AS DOUBLE)").alias("tile_lat"),
        F.expr("try_cast(tile_lon AS DOUBLE)").alias("tile_lon"),
        F.trim("name").alias("name"),
    )


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated places by position: 1 name, 4 lat, 5 lon, 8 country, 10 region, 14 people.

    Short rows and rows without numeric coordinates are dropped; people that are not all
    digits count as 0.
    """
    parts = F.split(F.col("value"), "\t", -1)
    cols = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 15)
    people = F.when(F.col("people").rlike("^[0-9]+$"), F.expr("try_cast(people AS BIGINT)"))
    return (
        cols.select(
            F.col("p")[1].alias("name"),
            F.expr("try_cast(p[4] AS DOUBLE)").alias("lat"),
            F.expr("try_cast(p[5] AS DOUBLE)").alias("lon"),
            F.col("p")[8].alias("cc"),
            F.col("p")[10].alias("admin1"),
            F.col("p")[14].alias("people"),
        )
        .where("lat IS NOT NULL AND lon IS NOT NULL")
        .withColumn("population", F.coalesce(people, F.lit(0)))
        .drop("people")
    )


def read_lookup(spark: SparkSession, path: str, key_at: int, value_at: int) -> DataFrame:
    """``code -> name`` from a tab-separated file with ``#`` comment lines."""
    parts = F.split(F.col("value"), "\t", -1)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return (
        lines.select(parts.alias("p"))
        .where((F.size("p") > max(key_at, value_at)) & (F.col("p")[key_at] != ""))
        .select(F.col("p")[key_at].alias("code"), F.col("p")[value_at].alias("name"))
    )
