"""Tier algebra: merging, upserts, gaps, coverage and the years left to fetch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import calendar
from isotherm.operators.keyed import top_row
from isotherm.schemas import TIER_PRIORITY

DAY = ("cell_key", "date")


def tier_rank(tier: Column) -> Column:
    """0 for the tier that wins a shared date."""
    out = F.lit(len(TIER_PRIORITY))
    for name, rank in TIER_PRIORITY.items():
        out = F.when(tier == name, F.lit(rank)).otherwise(out)
    return out


def union_tiers(*tiers: DataFrame) -> DataFrame:
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier, allowMissingColumns=True)
    return out


def merge_tiers(rows: DataFrame) -> DataFrame:
    """Per cell and date the whole row of the best tier: archive, recent, forecast.

    An aggregate, not a window: each task keeps one row per day before the shuffle.
    """
    return top_row(rows, DAY, [-tier_rank(F.col("tier"))])


def upsert_by_date(old: DataFrame, new: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Old rows with the new rows laid over them, date by date."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return top_row(both, keys, [F.col("_new")]).drop("_new")


def dedupe_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row per key by ingestion order."""
    return top_row(rows, keys, [F.col(order)])


def merge_columns(old: DataFrame, new: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Column by column: the new value where there is one, else the old one.

    Dates and columns present on one side only survive. Both sides must be free of
    duplicate keys; run ``dedupe_last`` first.
    """
    keys = list(keys)
    columns = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c not in keys]
    left = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    right = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys])

    def value(c: str) -> Column:
        parts = [F.col(f"_n_{c}")] if c in new.columns else []
        parts += [F.col(f"_o_{c}")] if c in old.columns else []
        return F.coalesce(*parts).alias(c)

    return left.join(right, keys, "full_outer").select(*keys, *[value(c) for c in columns])


def join_sources(temperature: DataFrame, rain_wind: DataFrame) -> DataFrame:
    """Temperature drives the rows; rain and wind join by day; unsettled days are dropped."""
    extra = rain_wind.select(*DAY, "precip_mm", "wind_max_ms")
    joined = temperature.select(*DAY, "tmax_C", "tmin_C").join(extra, list(DAY), "left")
    return joined.where(F.col("tmax_C").isNotNull() | F.col("tmin_C").isNotNull())


def comparable(tier: Column, date: Column, target: Column) -> Column:
    """Keep everything but forecasts dated after the target day."""
    return ~((tier == "forecast") & (date > target))


def observed(tier: Column, metric: str) -> Column:
    """Keep measurements: never forecasts, and recent rain and wind are model output too."""
    if metric in ("precip", "wind"):
        return ~tier.isin("forecast", "recent")
    return tier != "forecast"


def archive_only(tier: Column) -> Column:
    return tier == "archive"


def overlap_slice(archive: DataFrame, wanted: DataFrame, start: str, today: Column, lag_days: int = 10) -> DataFrame:
    """Archive rows from ``start`` to ``lag_days`` before today, for the wanted cells.

    A cell without rows in that span simply has none in the result.
    """
    span = F.col("date").between(F.lit(start).cast("date"), F.date_sub(today, lag_days))
    return archive.where(span).join(wanted.select("cell_key").distinct(), "cell_key", "left_semi")


def missing_dates(recent: DataFrame, archive_end: DataFrame, today: Column) -> DataFrame:
    """Dates after the archive's last, up to today, that the recent tier lacks."""
    days = F.explode(F.sequence(F.date_add("archive_end", 1), today)).alias("date")
    expected = archive_end.where(F.date_add("archive_end", 1) <= today).select("cell_key", days)
    return expected.join(recent.select(*DAY).distinct(), list(DAY), "left_anti")


def coverage_by_year(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows per tile and year as the least of its cells, and the tile's newest date.

    A cell without any rows voids its tile: no rows come back for it.
    """
    counted = rows.groupBy("cell_key", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    newest = rows.groupBy("cell_key").agg(F.max("date").alias("_newest"))
    tiles = cells.select("cell_key", "tile_id")
    covered = (
        tiles.join(newest, "cell_key", "left")
        .groupBy("tile_id")
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.min("_newest").alias("newest"),
            F.bool_or(F.col("_newest").isNull()).alias("_void"),
        )
        .where(~F.col("_void"))
        .drop("_void")
    )
    per_year = (
        tiles.join(counted, "cell_key")
        .groupBy("tile_id", "year")
        .agg(F.count(F.lit(1)).alias("_present"), F.min("rows").alias("_least"))
    )
    least = F.when(F.col("_present") < F.col("cells"), F.lit(0).cast("long")).otherwise(F.col("_least"))
    return per_year.join(covered, "tile_id").select("tile_id", "year", least.alias("rows"), "newest")


def complete_years(coverage: DataFrame, latest: Column, slack: int = 5) -> DataFrame:
    """Tile-years with all their days but for the slack; the last year counts to ``latest``."""
    expected = F.when(F.col("year") < F.year(latest), calendar.days_in_year(F.col("year"))).when(
        F.col("year") == F.year(latest), F.dayofyear(latest)
    )
    return coverage.where(F.col("rows") >= expected - slack).select("tile_id", "year")


def year_spans(years: DataFrame, longest: int) -> DataFrame:
    """Contiguous years joined to spans of at most ``longest`` years."""
    ordered = Window.partitionBy("tile_id").orderBy("year")
    island = Window.partitionBy("tile_id", "_island")
    return (
        years.withColumn("_island", F.col("year") - F.row_number().over(ordered))
        .withColumn("_part", F.floor((F.col("year") - F.min("year").over(island)) / longest))
        .groupBy("tile_id", "_island", "_part")
        .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
        .drop("_island", "_part")
    )


def common_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*DAY).intersect(right.select(*DAY))


def frame_compare(left: DataFrame, right: DataFrame, columns: Sequence[str], tolerance: float = 5e-4, least: int = 0) -> DataFrame:
    """Per cell and column: shared days, differing days, largest difference, enough overlap."""
    joined = left.select(*DAY, *[F.col(c).alias(f"_l_{c}") for c in columns]).join(
        right.select(*DAY, *[F.col(c).alias(f"_r_{c}") for c in columns]), list(DAY)
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_l_{c}").alias("l"), F.col(f"_r_{c}").alias("r")) for c in columns])
    ).alias("_p")
    gap = F.abs(F.col("_p.l") - F.col("_p.r"))
    equal = (F.col("_p.l").isNull() & F.col("_p.r").isNull()) | F.coalesce(gap <= tolerance, F.lit(False))
    return (
        joined.select("cell_key", pairs)
        .groupBy("cell_key", F.col("_p.column").alias("column"))
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.count_if(~equal).alias("differing"),
            F.max(F.when(~equal, gap)).alias("max_diff"),
        )
        .withColumn("enough", F.col("days") >= least)
    )


def remap_keys(rows: DataFrame, moves: DataFrame, drops: DataFrame) -> DataFrame:
    """Rows under their new key; rows of dropped keys are gone."""
    kept = rows.join(drops.select("cell_key"), "cell_key", "left_anti")
    new = moves.select(F.col("old_key").alias("cell_key"), F.col("new_key").alias("_new"))
    return kept.join(new, "cell_key", "left").withColumn("cell_key", F.coalesce("_new", "cell_key")).drop("_new")


def staleness(objects: DataFrame, now: Column, ttl_hours: dict[str, int]) -> DataFrame:
    """Which tiers to refresh: too old, or a forecast that stops before today.

    ``objects`` has ``cell_key``, ``tier``, ``updated_at`` and ``last_date``.
    """
    limit = F.coalesce(*[F.when(F.col("tier") == t, F.lit(h)) for t, h in ttl_hours.items()])
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))) / 3600.0
    short = (F.col("tier") == "forecast") & (F.col("last_date") < F.to_date(now))
    return objects.withColumn("age_h", age).withColumn("expired", age >= limit).withColumn(
        "refresh", (age >= limit) | F.coalesce(short, F.lit(False))
    )


#: days before today that the sources have not settled yet
FRONTIER_DAYS = 9


def first_missing(days: DataFrame) -> DataFrame:
    """``cell_key, archive_end, first_missing``: the first day after the archive's last that ``recent`` lacks.

    ``days`` carry ``cell_key``, ``tier`` and ``date``; cells without an archive have no seam and no row.
    """
    ends = days.where("tier = 'archive'").groupBy("cell_key").agg(F.max("date").alias("archive_end"))
    after = days.where("tier = 'recent'").select(*DAY).join(ends, "cell_key").where("date > archive_end")
    present = after.select("cell_key", "archive_end", "date").unionByName(ends.withColumn("date", F.col("archive_end"))).distinct()
    follower = F.lead("date").over(Window.partitionBy("cell_key").orderBy("date"))
    holes = present.withColumn("_next", follower).where(F.col("_next").isNull() | (F.col("_next") > F.date_add("date", 1)))
    return holes.groupBy("cell_key", "archive_end").agg(F.min(F.date_add("date", 1)).alias("first_missing"))


def heal_rule(days: DataFrame, updated: DataFrame, now: Column, ttl_hours: int = 24, frontier_days: int = FRONTIER_DAYS) -> DataFrame:
    """Whether to refresh a cell's recent tier: an old hole at once, the unsettled tail only when its age allows.

    ``updated`` has ``cell_key`` and ``updated_at`` of the recent tier. ``due`` is when the refresh falls due if nothing
    arrives: at the end of the tier's life, once the first missing day has begun, or when that day has become a hole.
    """
    found = first_missing(days).join(updated.select("cell_key", "updated_at"), "cell_key")
    begins = F.col("first_missing").cast("timestamp")
    heal = F.date_add("first_missing", frontier_days).cast("timestamp")
    extend = F.greatest(F.col("updated_at").cast("timestamp") + F.make_dt_interval(hours=F.lit(ttl_hours)), begins)
    tail_only = F.col("first_missing") > F.date_sub(F.to_date(now), frontier_days)
    due = F.least(heal, extend)
    return found.select("cell_key", "first_missing", tail_only.alias("tail_only"), due.alias("due"), F.when(heal <= extend, "heal").otherwise("extend").alias("reason"), (due <= now.cast("timestamp")).alias("refresh"))


def degenerate(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Histories without any value, or with no spread at all."""
    spread = rows.groupBy(*keys).agg(F.count(value).alias("days"), F.stddev_samp(value).alias("_sd"))
    return spread.where((F.col("days") == 0) | (F.col("_sd") < 1e-6)).drop("_sd")
