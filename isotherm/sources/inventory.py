"""Object inventories and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``object``, ``bytes`` and ``digest`` of every file under a prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/=]+?)(?:\.csv[^/]*)?(?:/part-[^/]*)?$", 1)
    return files.where(~F.col("path").rlike(r"/[_.][^/]*$")).select(
        name.alias("object"), F.col("length").alias("bytes"), F.md5("content").alias("digest")
    )


def diff_inventory(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per object: same, mismatch, missing (left only) or extra (right only)."""
    joined = left.select("object", F.col("digest").alias("_l")).join(
        right.select("object", F.col("digest").alias("_r")), "object", "full_outer"
    )
    status = (
        F.when(F.col("_r").isNull(), "missing")
        .when(F.col("_l").isNull(), "extra")
        .when(F.col("_l") == F.col("_r"), "same")
        .otherwise("mismatch")
    )
    return joined.select("object", status.alias("status"))
