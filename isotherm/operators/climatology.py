"""Climatology of a cell: yearly bands, records, histograms, day-of-year bands."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import calendar, units
from isotherm.functions.calendar import CIRCLE_DAYS

# Quantiles of the yearly bands and the dial, and the fewest days a dial needs.
YEARLY = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
DIAL = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
MIN_DOYS = 8


def _quantile_columns(value: str, stats: dict[str, float]) -> tuple[Column, list[Column]]:
    packed = F.percentile(value, F.array(*[F.lit(p) for p in stats.values()])).alias("_q")
    return packed, [F.col("_q")[i].alias(name) for i, name in enumerate(stats)]


def yearly_bands(pool: DataFrame, value: str, stats: dict[str, float] = YEARLY) -> DataFrame:
    """Quantiles of the season's days per cell and year; days without the metric are skipped."""
    packed, columns = _quantile_columns(value, stats)
    years = pool.where(F.col(value).isNotNull()).groupBy("cell_key", F.year("date").alias("year")).agg(packed)
    return years.select("cell_key", "year", *columns)


def rolling_median(bands: DataFrame, columns: Sequence[str], radius: int = 2, trailing: int | None = None) -> DataFrame:
    """``moving_*``: medians over neighbouring years, null unless the whole frame exists."""
    ordered = Window.partitionBy("cell_key").orderBy("year")
    frame = ordered.rowsBetween(-radius, radius) if trailing is None else ordered.rowsBetween(1 - trailing, 0)
    size = 2 * radius + 1 if trailing is None else trailing
    full = F.count(F.lit(1)).over(frame) == size
    return bands.withColumns({f"moving_{c}": F.when(full, F.percentile(c, F.lit(0.5)).over(frame)) for c in columns})


def records(pool: DataFrame, value: str, keys: Sequence[str] = ("cell_key",)) -> DataFrame:
    """The highest and lowest day of a pool; the earliest wins a tie."""
    usable = pool.where(F.col(value).isNotNull() & ~F.isnan(value))
    day = F.unix_date("date")
    return usable.groupBy(*keys).agg(
        F.max_by(F.struct("date", F.col(value).alias("v")), F.struct(F.col(value), -day)).alias("_hi"),
        F.min_by(F.struct("date", F.col(value).alias("v")), F.struct(F.col(value), day)).alias("_lo"),
    ).select(
        *keys, F.col("_hi.date").alias("high_date"), F.col("_hi.v").alias("high"), F.col("_lo.date").alias("low_date"), F.col("_lo.v").alias("low")
    )


def extents(rows: DataFrame, value: str, keys: Sequence[str] = ("cell_key",)) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def available_years(rows: DataFrame) -> DataFrame:
    return rows.select("cell_key", F.year("date").alias("year")).distinct()


def monthly_summary(pool: DataFrame, value: str) -> DataFrame:
    return pool.where(F.col(value).isNotNull()).groupBy("cell_key", F.month("date").alias("month")).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def exceed_days(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    return rows.groupBy("cell_key", F.year("date").alias("year")).agg(
        F.count_if(F.col(value) >= threshold).alias("days"), F.max(value).alias("highest")
    )


def bin_axis(rows: DataFrame, value: str, metric: str, system: str = "metric") -> DataFrame:
    """Bin width and grid-aligned range per cell from the padded extent of its values."""
    axis = rows.groupBy("cell_key").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    pad = units.axis_pad(metric, system, F.col("_hi") - F.col("_lo"))
    low = F.col("_lo") - pad
    if metric in ("precip", "wind"):
        low = F.greatest(F.lit(0.0), low)
    axis = axis.withColumn("_dl", low).withColumn("_dh", F.col("_hi") + pad)
    axis = axis.withColumn("bin", units.bin_width(metric, system, F.col("_dh") - F.col("_dl")))
    return axis.select(
        "cell_key", "bin", F.floor(F.col("_dl") / F.col("bin")).alias("first_bin"), F.ceil(F.col("_dh") / F.col("bin")).alias("last_bin")
    )


def histogram(pool: DataFrame, axis: DataFrame, value: str, keys: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Days per bin for every bin of the axis, empty ones included.

    ``keys`` split the pool further; ``groups`` then lists the splits that must appear.
    """
    counted = (
        pool.where(F.col(value).isNotNull())
        .join(axis.select("cell_key", "bin"), "cell_key")
        .groupBy("cell_key", *keys, F.floor(F.col(value) / F.col("bin")).alias("_b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = axis.select("cell_key", "bin", F.explode(F.sequence("first_bin", F.col("last_bin") - 1)).alias("_b"))
    if groups is not None:
        every = every.join(F.broadcast(groups))  # the few periods of the chart
    return every.join(counted, ["cell_key", *keys, "_b"], "left").select(
        "cell_key", *keys, (F.col("_b") * F.col("bin")).alias("low"), (F.col("_b") * F.col("bin") + F.col("bin")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


class Period(NamedTuple):
    label: str
    first: int
    last: int


def consecutive_periods(last_year: int, length: int = 15, count: int = 3) -> list[Period]:
    """Back-to-back periods that end with the last full year, oldest first."""
    out = []
    for k in range(count, 0, -1):
        first = last_year - k * length + 1
        out.append(Period(f"{first}-{first + length - 1}", first, first + length - 1))
    return out


def split_periods(first: int, last: int) -> list[Period]:
    """Early and late half of a year range; a single year stays whole."""
    if last <= first:
        return [Period("whole", first, last)]
    middle = (first + last) // 2
    return [Period("early", first, middle), Period("late", middle + 1, last)]


def period_of(year: Column, periods: Sequence[Period]) -> Column:
    out = F.lit(None).cast("string")
    for p in periods:
        out = F.when(year.between(p.first, p.last), p.label).otherwise(out)
    return out


def share_partition(pool: DataFrame, pivots: DataFrame, value: str) -> DataFrame:
    """Whole-percent shares of the slices between a cell's pivots; they add up to 100.

    ``pivots`` has an ascending ``pivots`` array per cell; the last slice takes what
    rounding leaves.
    """
    sliced = (
        pool.where(F.col(value).isNotNull())
        .join(pivots, "cell_key")
        .groupBy("cell_key", F.size(F.filter("pivots", lambda p: p <= F.col(value))).alias("slice"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    every = pivots.select("cell_key", F.size("pivots").alias("_last"), F.explode(F.sequence(F.lit(0), F.size("pivots"))).alias("slice"))
    filled = every.join(sliced, ["cell_key", "slice"], "left").fillna(0, ["_n"])
    cell = Window.partitionBy("cell_key")
    pct = F.floor(F.col("_n") / F.sum("_n").over(cell) * 100 + 0.5)
    rounded = filled.withColumn("_p", F.when(F.col("slice") < F.col("_last"), pct).otherwise(F.lit(0)))
    return rounded.withColumn(
        "pct", F.when(F.col("slice") < F.col("_last"), F.col("_p")).otherwise(100 - F.sum("_p").over(cell)).cast("long")
    ).select("cell_key", "slice", "pct")


def circular_smooth(df: DataFrame, keys: Sequence[str], columns: Sequence[str], radius: int) -> DataFrame:
    """Mean over the days within ``radius`` on the 365-day circle, for the days that exist.

    Every day hands its values to its neighbours, so one aggregation smooths all columns.
    """
    if radius <= 0:
        return df.select(*keys, "doy", *columns)
    spread = df.withColumn("_k", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(
        "_d", F.pmod(F.col("doy") + F.col("_k"), F.lit(CIRCLE_DAYS))
    )
    return (
        spread.groupBy(*keys, F.col("_d").alias("doy"))
        .agg(*[F.avg(c).alias(c) for c in columns], F.bool_or(F.col("_k") == 0).alias("_here"))
        .where("_here")
        .drop("_here")
    )


def pooled_circular_median(rows: DataFrame, value: str, radius: int = 3) -> DataFrame:
    """Median of all values within ``radius`` days on the circle, for every day with any."""
    spread = rows.where(F.col(value).isNotNull()).select(
        "cell_key", F.col(value).alias("_v"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_k"),
        calendar.circle_doy(F.col("date")).alias("_doy"),
    )
    return spread.groupBy("cell_key", F.pmod(F.col("_doy") + F.col("_k"), F.lit(CIRCLE_DAYS)).alias("doy")).agg(
        F.percentile("_v", F.lit(0.5)).alias("median")
    )


def doy_bands(rows: DataFrame, value: str, periods: Sequence[Period], radius: int, stats: dict[str, float] = DIAL) -> DataFrame:
    """Smoothed day-of-year quantiles per cell and period; sparse periods are left out."""
    packed, columns = _quantile_columns(value, stats)
    daily = (
        rows.where(F.col(value).isNotNull())
        .withColumn("period", period_of(F.year("date"), periods))
        .where(F.col("period").isNotNull())
        .groupBy("cell_key", "period", calendar.circle_doy(F.col("date")).alias("doy"))
        .agg(packed)
        .select("cell_key", "period", "doy", *columns)
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("cell_key", "period"))
    dense = daily.withColumn("_m", size).where(F.col("_m") > MIN_DOYS).drop("_m")
    return circular_smooth(dense, ["cell_key", "period"], list(stats), radius)


def outliers(rows: DataFrame, bands: DataFrame, value: str, periods: Sequence[Period], low: str = "p01", high: str = "p99") -> DataFrame:
    """Days outside the smoothed envelope of their own period."""
    marked = rows.where(F.col(value).isNotNull()).select(
        "cell_key", "date", F.col(value).alias("value"), period_of(F.year("date"), periods).alias("period"), calendar.circle_doy(F.col("date")).alias("doy")
    )
    joined = marked.join(bands.select("cell_key", "period", "doy", low, high), ["cell_key", "period", "doy"])
    return joined.where((F.col("value") < F.col(low)) | (F.col("value") > F.col(high))).drop(low, high)


def drawn_extent(bands: DataFrame, extra: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lowest and highest value of everything drawn: envelopes and outliers."""
    low, high = F.least(*columns), F.greatest(*columns)
    parts = bands.select("cell_key", low.alias("_l"), high.alias("_h")).unionByName(
        extra.select("cell_key", F.col("value").alias("_l"), F.col("value").alias("_h"))
    )
    return parts.groupBy("cell_key").agg(F.min("_l").alias("low"), F.max("_h").alias("high"))


def diff_ribbon(medians: DataFrame, value: str = "p50") -> DataFrame:
    """Early against late medians by day, with the higher half, closed over New Year."""
    early = medians.where("period = 'early'").select("cell_key", "doy", F.col(value).alias("early"))
    late = medians.where("period = 'late'").select("cell_key", "doy", F.col(value).alias("late"))
    both = early.join(late, ["cell_key", "doy"])
    size = F.count(F.lit(1)).over(Window.partitionBy("cell_key"))
    both = both.withColumn("_m", size).where(F.col("_m") > MIN_DOYS).drop("_m").withColumn("frac", F.col("doy") / CIRCLE_DAYS)
    closing = both.groupBy("cell_key").agg(F.min_by(F.struct("doy", "early", "late"), "doy").alias("_f")).select(
        "cell_key", "_f.doy", "_f.early", "_f.late", F.lit(1.0).alias("frac")
    )
    higher = F.when(F.col("late") > F.col("early"), "late").when(F.col("early") > F.col("late"), "early").otherwise("equal")
    return both.unionByName(closing).withColumn("higher", higher)
