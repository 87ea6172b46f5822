"""Correction surfaces on storage, one version per folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.bands import shoulders
from isotherm.schemas import DELTA_COLUMNS


def write_surface(df: DataFrame, path: str, version: int) -> None:
    """A new version folder; an existing one is never rewritten."""
    (
        df.repartitionByRange("cell_key", "var", "doy")
        .sortWithinPartitions("cell_key", "var", "doy", "hres")
        .write.mode("errorifexists")
        .parquet(f"{path}/v={version}")
    )


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """All versions with nine heads; versions without quarter heads get the probit rule."""
    raw = spark.read.option("mergeSchema", True).parquet(path)
    for missing in ("d25", "d75"):
        if missing not in raw.columns:
            raw = raw.withColumn(missing, F.lit(None).cast("double"))
    q25, q75 = shoulders(F.col("d10"), F.col("dmid"), F.col("d90"))
    return raw.withColumns({"d25": F.coalesce("d25", q25), "d75": F.coalesce("d75", q75)}).select(
        "v", "cell_key", "var", "doy", "hres", *DELTA_COLUMNS
    )
