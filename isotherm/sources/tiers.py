"""Cell-day tiers on storage: one CSV object per tier and cell, or Parquet by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.schemas import CELL_DAY, VALUE_COLUMNS


def read_tier(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """Rows of one tier; the cell key comes from the object's name.

    Works on flat objects (``archive_51.5_0.0.csv.gz``) and on the folders that
    ``write_tier_objects`` makes. A blank field is null.
    """
    key = F.regexp_extract(F.col("_metadata.file_path"), tier + r"_([^/]+?)(?:\.csv[^/]*)?(?:/[^/]*)?$", 1)
    rows = (
        spark.read.schema(CELL_DAY)
        .option("header", True)
        .option("nullValue", "")
        .option("recursiveFileLookup", True)
        .csv(path)
        .select(key.alias("cell_key"), "date", *VALUE_COLUMNS)
    )
    return rows.where(F.col("date").isNotNull()).withColumn("tier", F.lit(tier))


def write_tier_objects(df: DataFrame, path: str, tier: str) -> None:
    """Date-sorted gzip CSV, one folder per cell, under ``path``."""
    (
        df.where(F.col("tier") == tier)
        .select(F.concat(F.lit(f"{tier}_"), "cell_key").alias("object"), "date", *VALUE_COLUMNS)
        .repartition("object")
        .sortWithinPartitions("object", "date")
        .write.mode("overwrite")
        .partitionBy("object")
        .option("header", True)
        .option("compression", "gzip")
        .csv(path)
    )


def write_tiers(df: DataFrame, path: str) -> None:
    """Parquet by tier, each file a sorted range of cells and dates.

    Ranges, not hashes of the cell, so one long history spreads over several files and
    file statistics still prune by cell. Dynamic overwrite replaces only the tiers present.
    """
    (
        df.repartitionByRange("tier", "cell_key", "date")
        .sortWithinPartitions("cell_key", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tier")
        .parquet(path)
    )


def read_tiers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
