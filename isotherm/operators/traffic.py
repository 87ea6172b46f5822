"""The hit log: sessions, people, buckets over time and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import traffic
from isotherm.operators.order_stats import quantiles
from isotherm.operators.prefix import NUMBER, scan

# The gap that ends a session and the pages that mark a person.
GAP_SECONDS = 1800
HUMAN_PAGES = 3
TOP_COUNTRIES = 8
BUCKETS = {"10m": 600, "hour": 3600, "day": 86400}


def seconds(ts: Column) -> Column:
    """Microsecond-exact seconds of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def sessionize(hits: DataFrame) -> DataFrame:
    """``session``: number of the visitor's browsing session; a gap over 30 minutes ends it.

    Hits inside one half-hour slot always belong together, so the log is first reduced to
    one row per visitor and slot. The window then holds at most as many rows as there are
    slots in the period, however many hits one visitor makes.
    """
    slot = F.floor(seconds(F.col("ts")) / GAP_SECONDS)
    slotted = hits.withColumn("_slot", slot)
    slots = slotted.groupBy("visitor", "_slot").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    ordered = Window.partitionBy("visitor").orderBy("_slot")
    gap = seconds(F.col("_first")) - seconds(F.lag("_last").over(ordered))
    starts = slots.withColumn("_new", F.coalesce(gap > GAP_SECONDS, F.lit(True)).cast("int"))
    numbered = starts.withColumn("session", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return slotted.join(numbered.select("visitor", "_slot", "session"), ["visitor", "_slot"]).drop("_slot")


def sessions(hits: DataFrame) -> DataFrame:
    """One row per session: start, end, hits and distinct pages."""
    return sessionize(hits).groupBy("visitor", "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("hits"), F.count_distinct("page").alias("pages")
    )


def browsing_people(hits: DataFrame) -> DataFrame:
    """Visitors with at least three distinct content pages in one session."""
    content = hits.where(traffic.content_page(F.col("page"))).select("visitor", "ts", "page")
    return sessions(content).where(F.col("pages") >= HUMAN_PAGES).select("visitor").distinct()


def flag_humans(hits: DataFrame, bare_since: str) -> DataFrame:
    """``human``: not automated, and either no bot signature or browsing like a person."""
    people = browsing_people(hits).withColumn("_browses", F.lit(True))
    signature = traffic.bot_signature(F.col("asn_org"), F.col("ua"), F.col("page"), F.col("ts"), bare_since)
    joined = hits.join(people, "visitor", "left")
    human = ~traffic.automation(F.col("ua")) & (~signature | F.coalesce("_browses", F.lit(False)))
    return joined.withColumn("human", human).drop("_browses")


def time_bucket(ts: Column, size: str) -> Column:
    if size == "10m":
        floored = F.floor(F.minute(ts) / 10) * 10
        return F.date_trunc("hour", ts).cast("timestamp_ntz") + F.make_dt_interval(mins=floored.cast("int"))
    return F.date_trunc(size, ts).cast("timestamp_ntz")


def hits_over_time(hits: DataFrame, size: str, people: bool = False) -> DataFrame:
    """Hits, or distinct visitors, per bucket and top country, without gaps in time.

    The eight countries with the most hits stand alone, the rest are "Other".
    """
    named = hits.withColumn("country", F.coalesce("country", F.lit("??")))
    top = named.groupBy("country").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "country").limit(TOP_COUNTRIES)
    grouped = named.join(F.broadcast(top.select("country", F.lit(True).alias("_top"))), "country", "left").select(
        time_bucket(F.col("ts"), size).alias("bucket"), F.when(F.col("_top"), F.col("country")).otherwise("Other").alias("country"), "visitor"
    )
    measure = F.count_distinct("visitor") if people else F.count(F.lit(1))
    counted = grouped.groupBy("bucket", "country").agg(measure.alias("n"))
    span = counted.agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_z"))
    step = F.make_dt_interval(secs=F.lit(BUCKETS[size]))
    every = span.select(F.explode(F.sequence("_a", "_z", step)).alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", "country", F.coalesce("n", F.lit(0)).alias("n"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """Rows, people and first and last day; approximate people would do on a dashboard."""
    return hits.agg(
        F.count(F.lit(1)).alias("shown"), F.count_distinct("visitor").alias("people"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day")
    )


def top_shares(hits: DataFrame, column: str, k: int) -> DataFrame:
    """The most common values with their share of all rows."""
    counted = hits.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.orderBy(F.col("n").desc(), column).limit(k).join(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("_t")).alias("pct"))


def country_mix(hits: DataFrame, column: str, k: int) -> DataFrame:
    """Per value: total views and its ``k`` most common countries."""
    counted = hits.groupBy(column, "country").agg(F.count(F.lit(1)).alias("n"))
    # one entry per country, so the list is as short as the list of countries
    ranked = counted.groupBy(column).agg(F.sum("n").alias("views"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "country"))).alias("_c"))
    text = F.transform(F.slice("_c", 1, k), lambda c: F.concat_ws(" ", c["country"], (-c["m"]).cast("string")))
    return ranked.select(column, "views", F.array_join(text, ", ").alias("mix"))


def sort_table(hits: DataFrame, column: str, descending: bool, then: Sequence[str] = ()) -> DataFrame:
    """Ordered by any column, a missing value counting as empty text; ``position`` (from 1) is a row's place in the order."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return scan(hits, [key.desc() if descending else key.asc(), *[F.col(c) for c in then]]).withColumnRenamed(NUMBER, "position").drop("rows")


def people_by(hits: DataFrame, column: str) -> DataFrame:
    """Hits and distinct people per value; a value with most of the hits is counted by visitor first, in many tasks."""
    by_visitor = hits.groupBy(column, "visitor").agg(F.count(F.lit(1)).alias("_n"))
    return by_visitor.groupBy(column).agg(F.sum("_n").alias("hits"), F.count("visitor").alias("people"))


def metric_tops(hits: DataFrame) -> DataFrame:
    """How often each metric is looked at by a link to a card, with its share of all such views."""
    cards = hits.select(F.regexp_extract("page", traffic.CARD_PAGE, 4).alias("metric")).where("metric <> ''")
    return top_shares(cards, "metric", len(traffic.METRIC_WORDS))


def link_views(hits: DataFrame) -> DataFrame:
    """Views per location: of the forecast file that a page fetches for it, and of its cards."""

    def located(kind: str, pattern: str) -> DataFrame:
        lat, lon = (F.regexp_extract("page", pattern, k) for k in (1, 2))
        return hits.select(F.lit(kind).alias("kind"), lat.alias("_a"), lon.alias("_o"), "country").where("_a <> ''")

    both = located("forecast", traffic.TIER_FILE).unionByName(located("card", traffic.CARD_PAGE))
    counted = both.groupBy("kind", F.col("_a").cast("double").alias("lat"), F.col("_o").cast("double").alias("lon"), "country").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("kind", "lat", "lon").agg(F.sum("_n").alias("views"), F.count(F.lit(1)).alias("countries"))


def search_distances(hits: DataFrame, probs: Sequence[float] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """How far the place served lies from the place asked for, over all searches that were served: exact quantiles."""
    served = hits.where("kind = 'search' AND dist_km IS NOT NULL")
    return quantiles(served, [], "dist_km", probs).select("n", *[F.col("q")[k].alias(f"p{round(100 * p)}") for k, p in enumerate(probs)])


def worst_searches(hits: DataFrame, k: int) -> DataFrame:
    """The queries whose worst answer lay farthest away."""
    return search_gaps(hits, 0.0).where("worst_km IS NOT NULL").orderBy(F.col("worst_km").desc(), "query").limit(k).select("query", "worst_km", "searches")


def never_matched(hits: DataFrame) -> DataFrame:
    """Queries that no search ever found a place for."""
    return search_gaps(hits, 0.0).where("unmatched = searches").select("query", "searches")


def search_gaps(hits: DataFrame, far_km: float) -> DataFrame:
    """Per query: searches, those never matched, those served from far away, the worst distance."""
    found = hits.where("kind = 'search'").groupBy("query")
    return found.agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("matched").isNull()).alias("unmatched"), F.count_if(F.col("dist_km") > far_km).alias("far"), F.max("dist_km").alias("worst_km")
    )
