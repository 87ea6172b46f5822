"""Exact nearest neighbours as equi-joins on grid buckets.

Phase one looks in the 3 x 3 buckets around a query, in buckets of growing size. That answer is final when it is closer
than anything outside those buckets can be. For the few queries where it is not, the
occupied buckets are summarised (centre and radius; their number has a fixed bound set by
the globe and the bucket size), each query keeps only the buckets that could still hold the
nearest place, and only those are joined. What a step leaves open is a written table, so the plan repeats no step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions import geo
from isotherm.session import materialize

#: buckets a side of the blocks above them
BLOCK = 10


class Sphere:
    """Great-circle distance in kilometres over latitude and longitude."""

    def __init__(self, radius: float = geo.EARTH_KM):
        self.radius = radius

    def distance(self, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
        return geo.haversine_km(y1, x1, y2, x2, self.radius)

    def buckets(self, y: Column, x: Column, size: float) -> tuple[Column, Column]:
        return F.floor(y / size).cast("int"), F.floor(F.pmod(x + 180, F.lit(360.0)) / size).cast("int")

    def wrap(self, bx: Column, size: float) -> Column:
        return F.pmod(bx, F.lit(int(math.ceil(360 / size))))

    def reach(self, y: Column, size: float) -> Column:
        """A place outside the 3 x 3 buckets is at least this far away."""
        sideways = F.asin(F.greatest(F.lit(0.0), F.cos(F.radians(y))) * F.lit(math.sin(math.radians(size))))
        return F.least(F.lit(math.radians(size)), sideways) * F.lit(self.radius)


class Plane:
    """Plain distance over two numbers; no wrap-around."""

    def distance(self, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
        return F.sqrt(geo.squared_degrees(y1, x1, y2, x2))

    def buckets(self, y: Column, x: Column, size: float) -> tuple[Column, Column]:
        return F.floor(y / size).cast("int"), F.floor(x / size).cast("int")

    def wrap(self, bx: Column, size: float) -> Column:
        return bx

    def reach(self, y: Column, size: float) -> Column:
        return F.lit(float(size))


def candidates(
    queries: DataFrame,
    places: DataFrame,
    metric: Sphere | Plane,
    size: float,
    within: Sequence[str] = (),
) -> DataFrame:
    """Query-place pairs from the 3 x 3 buckets around each query.

    Both sides carry ``y``/``x`` (queries) and ``py``/``px`` (places) columns; ``within``
    names columns that must agree, such as a tile.
    """
    by, bx = metric.buckets(F.col("y"), F.col("x"), size)
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    spread = (
        queries.withColumn("_by", F.explode(F.transform(steps, lambda s: by + s)))
        .withColumn("_bx", F.explode(F.array_distinct(F.transform(steps, lambda s: metric.wrap(bx + s, size)))))
    )
    py, px = metric.buckets(F.col("py"), F.col("px"), size)
    keyed = places.withColumn("_by", py).withColumn("_bx", px)
    return spread.join(keyed, [*within, "_by", "_bx"]).drop("_by", "_bx")


def nearest(
    queries: DataFrame,
    places: DataFrame,
    query_id: Sequence[str],
    payload: Sequence[str],
    metric: Sphere | Plane | None = None,
    sizes: Sequence[float] = (0.125, 0.5, 2.0, 6.0),
    summary_size: float = 6.0,
    within: Sequence[str] = (),
    tie: Sequence[str] = (),
) -> DataFrame:
    """The nearest place of every query: the query columns, ``dist`` and ``payload``.

    Queries at one spot share their answer, and of the places at one spot only the one that wins its ties can be nearest,
    so the work follows the distinct spots.

    ``query_id`` names the queries in the result; ``sizes`` are the bucket sizes tried in turn, each on what the one before
    left open, so a query meets a large bucket only where the small ones around it are empty: small
    buckets keep dense places cheap, large ones only ever meet thinly settled ground.
    Ties go to the smallest ``tie`` columns. A query with no place in its ``within`` group
    keeps null ``dist`` and payload. On a sphere the sizes must divide 360.
    """
    metric = metric or Sphere()
    within = list(within)
    columns = [*within, "y", "x"]
    # the ids need no part: a spot's answer goes to all its queries
    near = F.struct(F.col("dist"), *[F.col(t) for t in tie], *[F.col(p) for p in payload if p not in tie])
    carried = list(dict.fromkeys([*tie, *payload]))
    first = F.min(F.struct(*carried)).alias("_first")
    spots = places.where("py IS NOT NULL AND px IS NOT NULL").groupBy(*within, "py", "px").agg(first)
    side = spots.select(*within, "py", "px", *[F.col(f"_first.{c}").alias(c) for c in carried])

    def best(pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumn("dist", metric.distance(F.col("y"), F.col("x"), F.col("py"), F.col("px")))
        return scored.groupBy(*columns).agg(F.min(near).alias("_best"))

    rest = queries.select(*columns).where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).distinct()
    answers = None
    for size in sizes:
        # stored: what is settled and what is not are read from it, and no later size repeats this one
        tried = materialize(rest.join(best(candidates(rest, side, metric, size, within)), columns, "left"), "nearest")
        # a place outside the buckets may lie at the reach, but for the last bits, and win the tie
        settled = F.coalesce(F.col("_best.dist") < metric.reach(F.col("y"), size) * (1 - 1e-9), F.lit(False))
        found = tried.where(settled).select(*columns, "_best")
        answers = found if answers is None else answers.unionByName(found)
        rest = tried.where(~settled).select(*columns)
    answers = answers.unionByName(best(_open_places(rest, side, columns, columns, within, metric, summary_size)))
    return (
        queries.join(answers, columns, "left")
        .withColumn("dist", F.col("_best.dist"))
        .withColumns({p: F.col(f"_best.{p}") for p in payload})
        .drop("_best")
    )


def _open_places(rest: DataFrame, side: DataFrame, ids: list[str], columns: list[str], within: list[str], metric: Sphere | Plane, size: float) -> DataFrame:
    """Query-place pairs that hold the nearest place of every open query, wherever it is.

    Occupied buckets and, above them, blocks of BLOCK x BLOCK buckets are summarised by centre and radius. A query first
    drops the blocks that cannot reach its nearest place, then the buckets of the blocks left, and meets the places of the rest.
    On a globe there are at most 36 blocks; only open queries come here.
    """
    by, bx = metric.buckets(F.col("py"), F.col("px"), size)
    keyed = side.withColumn("_by", by).withColumn("_bx", bx).withColumn("_ky", F.floor(F.col("_by") / BLOCK).cast("int")).withColumn("_kx", F.floor(F.col("_bx") / BLOCK).cast("int"))

    def summary(*keys: str) -> DataFrame:
        group = [*within, *keys]
        centre = keyed.groupBy(*group).agg(F.avg("py").alias("_cy"), F.avg("px").alias("_cx"))
        apart = metric.distance(F.col("_cy"), F.col("_cx"), F.col("py"), F.col("px"))
        return keyed.join(centre, group).groupBy(*group, "_cy", "_cx").agg(F.max(apart).alias("_r"))

    gap = metric.distance(F.col("y"), F.col("x"), F.col("_cy"), F.col("_cx"))

    def reachable(pairs: DataFrame, keep: list[str]) -> DataFrame:
        """Pairs of a query and a bucket that may hold its nearest place: no farther than the least certain distance."""
        bounded = pairs.withColumn("_near", gap - F.col("_r")).withColumn("_far", gap + F.col("_r")).drop("_cy", "_cx", "_r")
        limit = bounded.groupBy(*ids).agg(F.min("_far").alias("_limit"))
        return bounded.join(limit, ids).where(F.col("_near") <= F.col("_limit") + 1e-6).select(*columns, *keep)

    # the blocks of a group are few: one list each, opened once per query
    blocks = summary("_ky", "_kx").withColumn("_one", F.lit(1)).groupBy("_one", *within).agg(F.collect_list(F.struct("_ky", "_kx", "_cy", "_cx", "_r")).alias("_blocks"))
    opened = rest.withColumn("_one", F.lit(1)).join(F.broadcast(blocks) if not within else blocks, ["_one", *within]).select(*columns, F.inline("_blocks"))
    near_blocks = materialize(reachable(opened, ["_ky", "_kx"]), "nearest")
    fine = summary("_ky", "_kx", "_by", "_bx")
    near_buckets = reachable(near_blocks.join(fine, [*within, "_ky", "_kx"]), ["_by", "_bx"])
    return near_buckets.join(keyed.drop("_ky", "_kx"), [*within, "_by", "_bx"])
