"""The analytics data model as views over the given star-schema tables.

Cells, sites and visitors are ranges of a key, so their number grows with the tables while
the days per cell stay dense. Sums run over whole cents or percents, so the views hold the
same bits whichever engine and order added them up; divisors with large prime factors keep
means off decimal ties, where rounding conventions would differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import bands
from isotherm.functions.rounding import half_up
from isotherm.schemas import BAND_COLUMNS, LEVELS
from isotherm.session import materialize, staging_path

SUPPLIERS_PER_CELL = 20
USERS_PER_SITE = 75
USERS_PER_VISITOR = 15
PARTS_PER_TILE = 2500
CUSTOMERS_PER_TILE = 1875


def block(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def spread_coordinates(key: Column, a: int, b: int) -> tuple[Column, Column]:
    lat = (key * a) % 1400 / 10.0 - 57
    lon = (key * b) % 3600 / 10.0 - 180
    return F.round(lat, 1), F.round(lon, 1)


class Tables:
    """Lazy views; every one reads only the columns it needs from Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def cell_day(self) -> DataFrame:
        date = F.col("l_shipdate").cast("date")
        tier = (
            F.when(F.col("date") < F.lit("2001-01-01").cast("date"), "archive")
            .when(F.col("date") < F.lit("2001-05-01").cast("date"), "recent")
            .otherwise("forecast")
        )
        rain = F.when(F.col("l_returnflag") == "R", cents("l_discount")).otherwise(F.lit(0))
        return (
            self.read("lineitem")
            .groupBy(
                F.concat(F.lit("c"), block("l_suppkey", SUPPLIERS_PER_CELL).cast("string")).alias("cell_key"),
                date.alias("date"),
            )
            .agg(
                F.max("l_quantity").alias("tmax_C"),
                F.min("l_quantity").alias("tmin_C"),
                F.sum(rain).cast("double").alias("precip_mm"),
                (F.max("l_extendedprice") / 3600).alias("wind_max_ms"),
            )
            .withColumn("tier", tier)
        )

    @cached_property
    def tier_rows(self) -> DataFrame:
        """The same days as three overlapping tiers with shifted values."""
        base = self.cell_day.drop("tier")

        def shifted(lo: str, hi: str, tier: str, shift: float) -> DataFrame:
            day = F.col("date")
            part = base.where((day >= F.lit(lo).cast("date")) & (day < F.lit(hi).cast("date")))
            values = {c: F.col(c) + shift for c in ("tmax_C", "tmin_C", "precip_mm", "wind_max_ms")}
            return part.withColumns(values).withColumn("tier", F.lit(tier))

        return (
            shifted("1990-01-01", "2001-01-01", "archive", 0.0)
            .unionByName(shifted("2000-12-15", "2001-05-01", "recent", 0.5))
            .unionByName(shifted("2001-04-15", "2010-01-01", "forecast", 1.0))
        )

    @cached_property
    def pairs_wide(self) -> DataFrame:
        """Truth (``era5_*``) and forecast (``hres_*``) per cell and day."""
        n = F.count(F.lit(1))
        percent_left = F.lit(100) - cents("l_discount")
        rainy = F.col("l_returnflag") == "R"
        return (
            self.read("lineitem")
            .groupBy(
                F.concat(F.lit("c"), block("l_suppkey", SUPPLIERS_PER_CELL).cast("string")).alias("cell_key"),
                F.col("l_shipdate").cast("date").alias("date"),
            )
            .agg(
                (F.sum(cents("l_extendedprice") * percent_left).cast("double") / (n * F.lit(1.0007e7))).alias("era5_tmax"),
                (F.sum(cents("l_extendedprice")).cast("double") / (n * F.lit(1.0007e5))).alias("hres_tmax"),
                F.sum(F.when(rainy, cents("l_discount")).otherwise(F.lit(0))).cast("double").alias("era5_precip"),
                F.sum(F.when(rainy, cents("l_tax")).otherwise(F.lit(0))).cast("double").alias("hres_precip"),
                (F.max("l_extendedprice") / 3600).alias("era5_wind"),
                (F.max(cents("l_extendedprice") * (F.lit(100) + cents("l_tax"))).cast("double") / F.lit(3.7e7)).alias("hres_wind"),
            )
        )

    @property
    def _wide(self) -> DataFrame:
        """The stored pairs where a query has stored them already."""
        return self.__dict__.get("stored_pairs", self.pairs_wide)

    @cached_property
    def stored_pairs(self) -> DataFrame:
        """The wide pairs as a stored frame, for queries that pass over them several times; ``roles`` does."""
        return materialize(self.pairs_wide, "pairs")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._wide.select(
            "cell_key", "date", F.col("era5_tmax").alias("era5"), F.col("hres_tmax").alias("hres")
        )

    @cached_property
    def pairs_long(self) -> DataFrame:
        """One row per cell, day and metric: ``archive`` and ``hres``."""
        wide = self.pairs_wide
        return wide.selectExpr(
            "cell_key",
            "date",
            "stack(3, 'tmax', era5_tmax, hres_tmax, 'precip', era5_precip, hres_precip, "
            "'wind', era5_wind, hres_wind) AS (metric, archive, hres)",
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly readings per site; ``tp`` accumulates from 01:00 to 00:00."""
        n = F.count(F.lit(1))
        hour = F.date_trunc("hour", F.col("ts").cast("timestamp_ntz"))
        steps = (
            self.read("events")
            .groupBy(
                F.concat(F.lit("c"), block("user_id", USERS_PER_SITE).cast("string")).alias("cell_key"),
                hour.cast("timestamp_ntz").alias("ts"),
            )
            .agg(
                (F.lit(273.15) + F.sum(cents("value")).cast("double") / n / 2300).alias("t2m"),
                F.sum(cents("value")).alias("_c"),
                (F.sum(cents("value")).cast("double") / n / 5000).alias("u10"),
                (F.max("value") / 60).alias("v10"),
            )
        )
        window = (
            Window.partitionBy("cell_key", F.expr("CAST(ts - INTERVAL 1 HOUR AS DATE)"))
            .orderBy("ts")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        total = F.sum("_c").over(window).cast("double") / F.lit(1.3e8)
        return steps.select("cell_key", "ts", "t2m", total.alias("tp"), "u10", "v10")

    @cached_property
    def hits(self) -> DataFrame:
        k = F.col("k")
        metric = F.element_at(F.array(*[F.lit(m) for m in ("tmax", "tmin", "precip", "wind")]), (k % 4 + 1))
        day = F.date_format("ts", "yyyy-MM-dd")
        page = (
            F.when(k % 10 == 9, F.concat(F.lit("/"), k % 90, F.lit(".5,"), k, F.lit(".5")))
            .otherwise(F.concat(F.lit("/"), k % 90, F.lit(".5,"), k, F.lit(".5/"), day, F.lit("/"), metric))
        )
        agents = (
            "Mozilla/5.0 (X11) AppleWebKit/537 Chrome/126 Safari/537",
            "Mozilla/5.0 (iPhone) Version/17 Safari/604",
            "python-requests/2.31",
            "SomeClient/1.0",
            "Mozilla/5.0 (compatible; Googlebot/2.1)",
        )
        orgs = ("Amazon.com, Inc.", "Cloudflare, Inc.", "Example Telecom", "City Broadband", "Hetzner Online")
        searching = F.col("event_type") == "click"
        return (
            self.read("events")
            .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .select(
                "event_id",
                F.col("ts").cast("timestamp_ntz").alias("ts"),
                block("user_id", USERS_PER_VISITOR).cast("string").alias("visitor"),
                F.when(searching, "search").otherwise(F.col("event_type")).alias("kind"),
                page.alias("page"),
                F.concat(F.lit("N"), F.col("user_id") % 12).alias("country"),
                F.concat(F.lit("10.0."), k, F.lit("."), F.col("user_id") % 250).alias("ip"),
                F.concat(F.lit("https://site"), k % 7, F.lit(".example.org/a?b=1")).alias("referer_url"),
                F.element_at(F.array(*[F.lit(o) for o in orgs]), (F.col("user_id") % 5 + 1).cast("int")).alias("asn_org"),
                F.element_at(F.array(*[F.lit(a) for a in agents]), (k % 5 + 1)).alias("ua"),
                F.when(searching, F.concat(F.lit("town "), k)).alias("query"),
                F.when(searching & (k % 6 != 0), F.concat(F.lit("Town "), k)).alias("matched"),
                F.when(searching & (k % 6 != 0), F.concat(F.lit("Cell "), k % 20)).alias("served"),
                F.when(searching & (k % 6 != 0), F.col("value") * 3).alias("dist_km"),
            )
        )

    @cached_property
    def cells(self) -> DataFrame:
        key = F.col("c_custkey")
        lat, lon = spread_coordinates(key, 37, 91)
        return self.read("customer").select(
            key.alias("cell_id"),
            lat.alias("lat"),
            lon.alias("lon"),
            F.round(F.abs(F.col("c_acctbal")) * 100).cast("long").alias("population"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("country"),
            F.concat("c_mktsegment", F.lit(", "), F.concat(F.lit("Land "), F.col("c_nationkey"))).alias("label"),
        )

    @cached_property
    def gazetteer(self) -> DataFrame:
        key = F.col("s_suppkey")
        lat, lon = spread_coordinates(key, 53, 97)
        return self.read("supplier").select(
            key.alias("place_id"),
            F.round(lat + 0.03, 2).alias("lat"),
            F.round(lon + 0.03, 2).alias("lon"),
            F.round(F.abs(F.col("s_acctbal")) * 100).cast("long").alias("population"),
            F.concat(F.lit("Place "), key % 40).alias("name"),
            F.col("s_nationkey").alias("cc"),
        )

    @cached_property
    def gridpoints(self) -> DataFrame:
        key = F.col("p_partkey")
        step = key % PARTS_PER_TILE
        return self.read("part").select(
            block("p_partkey", PARTS_PER_TILE).alias("tile"),
            F.floor(step / 50).cast("int").alias("row"),
            (step % 50).cast("int").alias("col"),
            (F.col("p_size") >= 10).alias("land"),
        )

    @cached_property
    def grid_targets(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("cell_id"),
            block("c_custkey", CUSTOMERS_PER_TILE).alias("tile"),
            ((key * 37) % 40).cast("int").alias("row"),
            ((key * 91) % 50).cast("int").alias("col"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        key = F.col("o_orderkey")
        lat = (key * 37) % 14000 / 100.0 - 57
        lon = (key * 91) % 36000 / 100.0 - 180
        sign = F.when(F.col("o_orderstatus") == "P", -1.0).otherwise(1.0)
        return self.read("orders").select(
            F.round(lat, 2).alias("lat"), F.round(lon, 2).alias("lon"), (F.col("o_totalprice") * sign).alias("pop")
        )

    @cached_property
    def static(self) -> DataFrame:
        """Per-cell features of the pair frame."""
        lat, lon = spread_coordinates(F.col("k"), 137, 291)
        people = F.col("population")
        return (
            self.read("supplier")
            .groupBy(block("s_suppkey", SUPPLIERS_PER_CELL).alias("k"))
            .agg(F.sum(F.abs(cents("s_acctbal"))).alias("population"))
            .select(
                F.concat(F.lit("c"), F.col("k").cast("string")).alias("cell_key"),
                lat.alias("lat"),
                lon.alias("lon"),
                "population",
                (people % 3000).cast("double").alias("elevation"),
                ((people * 7) % 3000).cast("double").alias("hres_elevation"),
                (lat + 0.04).alias("hres_lat"),
                (lon - 0.03).alias("hres_lon"),
                F.concat(F.lit("Town "), F.col("k").cast("string")).alias("name"),
            )
        )

    @cached_property
    def banded(self) -> DataFrame:
        """Pairs with a nine-point band from each cell's monthly residuals."""
        by_month = self.pairs.groupBy("cell_key", F.month("date").alias("_m")).agg(
            F.percentile(F.col("era5") - F.col("hres"), F.array(*[F.lit(p) for p in LEVELS])).alias("_q")
        )
        heads = [half_up(F.col("hres") + F.col("_q")[i], 3).alias(c) for i, c in enumerate(BAND_COLUMNS)]
        return (
            self.pairs.withColumn("_m", F.month("date"))
            .join(by_month, ["cell_key", "_m"])
            .select("cell_key", "date", F.col("era5").alias("truth"), "hres", *heads)
        )

    @cached_property
    def roles(self) -> DataFrame:
        """Pairs with season, forecast version, labels and the blocked split, as a stored frame."""
        from isotherm.operators import pairs as ops

        labelled = ops.tail_labels(ops.with_versions(ops.with_bias(self.stored_pairs.select("cell_key", "date", F.col("era5_tmax").alias("era5"), F.col("hres_tmax").alias("hres")))))
        return materialize(ops.blocked_split(labelled), "roles")

    @cached_property
    def wet_pairs(self) -> DataFrame:
        """The rain pair, trace-clamped on both sides."""
        return self._wide.select(
            "cell_key",
            "date",
            bands.trace_clamp(F.col("era5_precip")).alias("era5"),
            bands.trace_clamp(F.col("hres_precip")).alias("hres"),
        )

    def staging(self, name: str) -> str:
        """A fresh folder for a table this query writes and reads back."""
        return staging_path(self.spark, name)
