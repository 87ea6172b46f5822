"""The hit log: enrichment on the way in and the newest rows on the way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)"


def url_host(url: Column) -> Column:
    """Host with port, or null for anything that is not a URL."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(host != "", host)


def pseudonym(ip: Column, ua: Column, salt: str) -> Column:
    """First 16 hex digits of sha256 over address, agent and salt joined by a bar."""
    parts = [F.coalesce(ip, F.lit("")), F.coalesce(ua, F.lit("")), F.lit(salt)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def is_local_host(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"^\[|\]$", "")
    return F.coalesce(name.isin("localhost", "127.0.0.1", "::1") | name.endswith(".localhost"), F.lit(False))


def ingest(raw: DataFrame, salt: str, owner_key: str | None = None) -> DataFrame:
    """Raw requests to hit rows; batch and streaming alike.

    Expects ``ip``, ``ua``, ``referer_url`` and optionally ``origin_url`` and ``owner``.
    """
    columns = raw.columns
    referer = url_host(F.col("referer_url"))
    origin = F.coalesce(url_host(F.col("origin_url")), referer) if "origin_url" in columns else referer
    owner = is_local_host(origin)
    if owner_key and "owner" in columns:
        owner = owner | F.coalesce(F.col("owner") == owner_key, F.lit(False))
    visitor = F.when(owner, F.lit("owner")).otherwise(pseudonym(F.col("ip"), F.col("ua"), salt))
    return (
        raw.withColumn("visitor", visitor)
        .withColumn("referer", referer)
        .withColumn("ua", F.when(F.col("ua") != "", F.col("ua")))
        .drop("ip", "referer_url", "origin_url", "owner")
    )


def newest(hits: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest rows, newest first.

    Hits are counted by hour; only the hours that can hold one of the newest rows are sorted.
    """
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    counted = hits.groupBy(hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    newer = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row: the oldest hour with fewer than ``limit`` hits after it
    cutoff = counted.withColumn("_newer", newer).where(F.col("_newer") < limit).agg(F.min("_hour").alias("_from"))
    recent = hits.join(F.broadcast(cutoff), F.col("_from").isNull() | (hour >= F.col("_from"))).drop("_from")
    return recent.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)
