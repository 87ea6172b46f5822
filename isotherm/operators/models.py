"""Point models of the correction on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions import calendar

FEATURES = ["hres", "elevation", "hres_elevation", "elev_diff_m", "dist_to_hres_km", "lat", "lon", "cos_doy", "sin_doy"]


def with_features(df: DataFrame) -> DataFrame:
    cos, sin = calendar.phase(F.col("date"))
    return df.withColumn("cos_doy", cos).withColumn("sin_doy", sin)


def fit_point_model(train: DataFrame, weight: str | None = None, rounds: int = 20, depth: int = 4) -> PipelineModel:
    """Boosted trees on absolute error: the median of the bias given the features."""
    stages = [
        StringIndexer(inputCol="fc_version", outputCol="_version", handleInvalid="keep"),
        VectorAssembler(inputCols=[*FEATURES, "_version"], outputCol="_features"),
        GBTRegressor(
            featuresCol="_features", labelCol="bias", predictionCol="point", lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=0,
            **({"weightCol": weight} if weight else {}),
        ),
    ]
    return Pipeline(stages=stages).fit(train)
