"""The truth-forecast pair frame: bias, versions, labels and the blocked split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import calendar, geo
from isotherm.operators.order_stats import average_rank_share

# Parameters of the split: every 5th month block tests, every 4th of the rest validates,
# and training days within 3 days of either are left out.
TEST_EVERY = 5
VALIDATE_EVERY = 4
EMBARGO_DAYS = 3

VERSION_BASE = "v1"
VERSION_CHANGES = (("1998-01-01", "v2"), ("2000-06-01", "v3"))


def pair(truth: DataFrame, forecast: DataFrame, values: Sequence[str], keys: Sequence[str] = ("cell_key", "date")) -> DataFrame:
    """Inner join on cell and day with ``era5_`` and ``hres_`` columns."""
    left = truth.select(*keys, *[F.col(c).alias(f"era5_{c}") for c in values])
    right = forecast.select(*keys, *[F.col(c).alias(f"hres_{c}") for c in values])
    return left.join(right, list(keys))


def with_bias(df: DataFrame) -> DataFrame:
    """The correction target: truth minus forecast."""
    return df.withColumn("bias", F.col("era5") - F.col("hres"))


def version_on(date: Column, changes: Sequence[tuple[str, str]] = VERSION_CHANGES, base: str = VERSION_BASE) -> Column:
    """The forecast version in force; the latest change on or before the date wins."""
    out = F.lit(base)
    for day, version in sorted(changes):
        out = F.when(date >= F.lit(day).cast("date"), F.lit(version)).otherwise(out)
    return out


def with_versions(df: DataFrame) -> DataFrame:
    return df.withColumn("fc_version", version_on(F.col("date")))


def band_label(share: Column, edge: float, low: str, high: str) -> Column:
    return F.when(share <= edge, low).when(share >= 1 - edge, high).otherwise("mid")


def tail_labels(df: DataFrame, group: Sequence[str] = ("cell_key", "season")) -> DataFrame:
    """Rank shares of truth (``u``) and forecast (``f``) in cell and season, and their tails."""
    if "season" not in df.columns:
        df = df.withColumn("season", calendar.calendar_season(F.col("date")))
    ranked = df.withColumn("u", average_rank_share("era5", group)).withColumn("f", average_rank_share("hres", group))
    return (
        ranked.withColumn("dec", band_label(F.col("u"), 0.1, "low", "high"))
        .withColumn("dec1", band_label(F.col("u"), 0.01, "p01", "p99"))
        .withColumn("fdec", band_label(F.col("f"), 0.1, "low", "high"))
    )


def tail_weight(share: Column, alpha: float) -> Column:
    """Weight 1 in the middle of the distribution, rising to 1 + alpha at its ends."""
    return 1 + F.lit(alpha) * F.abs(2 * (share - 0.5))


def month_blocks(df: DataFrame) -> DataFrame:
    """``block``: months since the first month in the frame."""
    origin = df.agg(F.min("date").alias("_origin"))
    return (
        df.join(F.broadcast(origin))  # exactly one row
        .withColumn("block", calendar.month_block(F.col("date"), F.col("_origin")))
        .drop("_origin")
    )


def block_roles(blocks: DataFrame) -> DataFrame:
    """``block -> role`` for the distinct blocks; at most a few thousand months."""
    at = F.row_number().over(Window.orderBy("block")) - 1
    held = F.floor(F.col("_at") / TEST_EVERY) + 1
    return (
        blocks.select("block")
        .distinct()
        .withColumn("_at", at)
        .withColumn(
            "role",
            F.when(F.col("_at") % TEST_EVERY == 0, "test")
            .when((F.col("_at") - held) % VALIDATE_EVERY == 0, "val")
            .otherwise("train"),
        )
        .drop("_at")
    )


def blocked_split(df: DataFrame) -> DataFrame:
    """``block`` and ``role``: test, val, train or embargo."""
    blocked = month_blocks(df)
    # one row per calendar day, so the side tables stay as small as the calendar
    days = blocked.select("date", "block").distinct()
    roles = days.join(F.broadcast(block_roles(days)), "block")
    near = (
        roles.where(F.col("role") != "train")
        .select(
            F.explode(
                F.sequence(F.date_sub("date", EMBARGO_DAYS), F.date_add("date", EMBARGO_DAYS))
            ).alias("date")
        )
        .distinct()
        .withColumn("_near", F.lit(True))
    )
    role = F.when((F.col("role") == "train") & F.col("_near"), "embargo").otherwise(F.col("role"))
    by_day = roles.join(near, "date", "left").select("date", role.alias("role"))
    return blocked.join(F.broadcast(by_day), "date")


def calibration_halves(df: DataFrame) -> DataFrame:
    """Test blocks in turn: ``half`` is calib for even ones, eval for odd ones."""
    tests = df.where("role = 'test'").select("block").distinct()
    halves = tests.withColumn(
        "half", F.when((F.row_number().over(Window.orderBy("block")) - 1) % 2 == 0, "calib").otherwise("eval")
    )
    return df.where("role = 'test'").join(F.broadcast(halves), "block")


def day_halves(date: Column) -> Column:
    return F.when(F.dayofmonth(date) % 2 == 1, "odd").otherwise("even")


def forecast_share(train: DataFrame, evaluation: DataFrame, value: str = "hres") -> DataFrame:
    """Share of the cell's training forecasts at or below each evaluated forecast.

    Equal forecasts are counted first, so the window sorts distinct values of one cell.
    """
    seen = train.groupBy("cell_key", value).agg(F.count(F.lit(1)).alias("_t"))
    asked = evaluation.select("cell_key", value).distinct().withColumn("_t", F.lit(0).cast("long"))
    steps = seen.unionByName(asked).groupBy("cell_key", value).agg(F.sum("_t").alias("_t"))
    upto = Window.partitionBy("cell_key").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy("cell_key")
    shares = steps.withColumn("forecast_pct", F.sum("_t").over(upto) / F.sum("_t").over(total)).drop("_t")
    return evaluation.join(shares, ["cell_key", value], "left")


FORECAST_BINS = ((0.01, "bottom 1%"), (0.05, "1-5%"), (0.25, "5-25%"), (0.75, "25-75%"), (0.95, "75-95%"), (0.99, "95-99%"), (1.0, "top 1%"))
REGIMES = ((0.60, "dry / <p60"), (0.80, "p60-80"), (0.90, "p80-90"), (0.95, "p90-95"), (0.99, "p95-99"), (1.0001, "top 1%"))


def forecast_bin(share: Column) -> Column:
    """Right-closed extremeness bins of a forecast within its cell."""
    out = F.when(share.isNull(), F.lit(None).cast("string"))
    for edge, label in FORECAST_BINS:
        out = out.when(share <= edge, label)
    return out


def forecast_regime(share: Column) -> Column:
    """Left-closed regimes for the rain study."""
    out = F.when(share.isNull(), F.lit(None).cast("string"))
    for edge, label in REGIMES:
        out = out.when(share < edge, label)
    return out


def attach_static(df: DataFrame, static: DataFrame) -> DataFrame:
    """Geographic features of the cell; fails in ``uncovered`` if a cell has none."""
    lat, lon = F.col("lat"), F.col("lon")
    features = static.withColumns(
        {
            "elev_diff_m": F.col("elevation") - F.col("hres_elevation"),
            "dist_to_hres_km": geo.haversine_km(lat, lon, F.col("hres_lat"), F.col("hres_lon"), geo.EARTH_KM_STUDY),
        }
    )
    return df.join(features, "cell_key", "left")


def uncovered(df: DataFrame, static: DataFrame) -> DataFrame:
    """Cells of the frame that the static table does not know."""
    return df.select("cell_key").distinct().join(static, "cell_key", "left_anti")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails unless the keys are unique on both sides.

    The check rides along as a count per key, so a violation fails the job that reads it.
    """
    keys = list(keys)

    def once(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
        ok = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("duplicate join key")))
        return packed.select(*keys, ok.alias("_r")).select(*keys, "_r.*")

    return once(left).join(once(right), keys)


def feed_gap(left: DataFrame, right: DataFrame, value: str, tolerance: float, keys: Sequence[str] = ("cell_key", "date")) -> DataFrame:
    """Absolute difference of two feeds on shared keys, with a ``differs`` flag."""
    joined = left.select(*keys, F.col(value).alias("_l")).join(right.select(*keys, F.col(value).alias("_r")), list(keys))
    gap = F.abs(F.col("_l") - F.col("_r"))
    return joined.select(*keys, gap.alias("gap"), (gap > tolerance).alias("differs"))
