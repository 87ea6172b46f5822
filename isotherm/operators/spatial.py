"""Places, cells and land: nearest, within a radius, naming, snapping and zonal sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import geo
from isotherm.functions.rounding import half_up, snap
from isotherm.operators.keyed import top_row
from isotherm.operators.nearest import Plane, Sphere, nearest
from isotherm.session import materialize

# Naming radii and population ratio.
PROMINENCE_KM = 8.0
PARENT_KM = 12.0
PARENT_RATIO = 4.0


def as_places(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("py", F.col(lat)).withColumn("px", F.col(lon))


def nearest_cell(queries: DataFrame, cells: DataFrame, query_id: str, payload: Sequence[str], radius: float = geo.EARTH_KM) -> DataFrame:
    """The nearest cell of every point and its great-circle distance ``km``."""
    points = queries.withColumn("y", F.col("lat")).withColumn("x", F.col("lon"))
    found = nearest(points, as_places(cells), [query_id], payload, Sphere(radius), tie=["cell_id"])
    return found.withColumnRenamed("dist", "km").drop("y", "x")


def within_radius(queries: DataFrame, places: DataFrame, km: float, on: Sequence[str] = (), radius: float = geo.EARTH_KM) -> DataFrame:
    """All query-place pairs at most ``km`` apart, with their distance ``km``.

    Both sides carry ``y``/``x`` and ``py``/``px``. Each place sits in one bucket; a query
    visits every bucket its radius touches, wider in longitude towards the poles. ``on``
    adds equality columns such as a name, so a common name still only meets its neighbours.
    """
    step = km / geo.KM_PER_DEGREE
    columns = max(1, math.floor(360 / max(step, 0.01)))
    size = 360 / columns
    edge = F.cos(F.radians(F.least(F.lit(89.9), F.abs("y") + step)))
    reach = F.least(F.lit(180.0), F.lit(step) / edge)

    def at(value: Column) -> Column:
        return F.floor(value / size).cast("int")

    visits = queries.withColumn("_by", F.explode(F.sequence(at(F.col("y") - step), at(F.col("y") + step)))).withColumn(
        "_bx",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(at(F.col("x") + 180 - reach), at(F.col("x") + 180 + reach)),
                    lambda b: F.pmod(b, F.lit(columns)),
                )
            )
        ),
    )
    keyed = places.withColumn("_by", at(F.col("py"))).withColumn(
        "_bx", F.least(at(F.pmod(F.col("px") + 180, F.lit(360.0))), F.lit(columns - 1))
    )
    distance = geo.haversine_km(F.col("y"), F.col("x"), F.col("py"), F.col("px"), radius)
    return visits.join(keyed, [*on, "_by", "_bx"]).withColumn("km", distance).where(F.col("km") <= km).drop("_by", "_bx")


def place_lookup(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Name of the cell a coordinate lies on, else of the nearest one in degrees.

    Distinct coordinates are looked up once, however often they occur.
    """
    keyed = points.withColumn("_key", geo.cell_key(F.col("lat"), F.col("lon")))
    named = top_row(
        cells.select(geo.cell_key(F.col("lat"), F.col("lon")).alias("_key"), "cell_id", F.col("name").alias("_exact")),
        ["_key"],
        [-F.col("cell_id")],
    ).drop("cell_id")
    distinct = keyed.select("_key", "lat", "lon").distinct().join(named, "_key", "left")
    misses = distinct.where(F.col("_exact").isNull()).select("lat", "lon")
    asked = misses.withColumn("y", F.col("lat")).withColumn("x", F.col("lon"))
    near = nearest(asked, as_places(cells), ["lat", "lon"], ["name"], Plane(), tie=["cell_id"])
    names = distinct.join(near.select("lat", "lon", F.col("name").alias("_near")), ["lat", "lon"], "left").select(
        "lat", "lon", F.coalesce("_exact", "_near").alias("place"), F.col("_exact").isNotNull().alias("exact")
    )
    return points.join(names, ["lat", "lon"], "left")


def name_cells(cells: DataFrame, places: DataFrame, k: int | None = None) -> DataFrame:
    """Name every cell after a place: the most populous within 8 km, else the nearest.

    A much larger place of another name within 12 km is added as the parent. ``k`` limits
    the places of a cell that are considered to its nearest, by projected distance; by default all in reach are.
    """
    asked = cells.select("cell_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    # a name depends on the spot alone, so cells at one spot share it
    spots = asked.where("y IS NOT NULL AND x IS NOT NULL").select("y", "x").distinct()
    towns = places.select(
        "place_id", F.col("name").alias("town"), F.col("population").alias("people"), "cc",
        F.col("lat").alias("py"), F.col("lon").alias("px"),
    )
    close = within_radius(spots, towns, PARENT_KM)
    planar = geo.projected_km(F.col("y"), F.col("x"), F.col("py"), F.col("px"))
    close = close.withColumn("_planar", planar).select("y", "x", "place_id", "town", "people", "cc", "km", "_planar")
    if k is not None:
        order = Window.partitionBy("y", "x").orderBy("_planar", "place_id")
        close = close.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    # of equal people the nearer by projected distance goes first
    nearer = [-F.col("_planar"), -F.col("place_id")]
    prominent = close.where(F.col("km") <= PROMINENCE_KM)
    chosen = top_row(prominent, ["y", "x"], [F.col("people"), *nearer]).drop("_planar")
    unnamed = spots.join(chosen.select("y", "x"), ["y", "x"], "left_anti")
    payload = ["place_id", "town", "people", "cc"]
    lonely = nearest(unnamed, towns, ["y", "x"], payload, Sphere(), tie=["place_id"]).withColumnRenamed("dist", "km")
    picked = materialize(chosen.unionByName(lonely.select(*chosen.columns)), "named")
    rivals = close.select("y", "x", F.col("town").alias("_town"), F.col("people").alias("_people"), "_planar", "place_id")
    parents = top_row(
        picked.select("y", "x", "town", "people")
        .join(rivals, ["y", "x"])
        .where((F.col("_town") != F.col("town")) & (F.col("_people") >= F.lit(PARENT_RATIO) * F.greatest("people", F.lit(1))))
        .select("y", "x", "_town", "_people", "_planar", "place_id"),
        ["y", "x"],
        [F.col("_people"), *nearer],
    ).select("y", "x", "_town")
    label = F.concat_ws(", ", F.col("town"), F.col("_town"))
    named = picked.join(parents, ["y", "x"], "left").select("y", "x", label.alias("name"), "cc", "km")
    # a cell without a place on the map is named after nothing
    return asked.join(named, ["y", "x"], "left").select("cell_id", F.coalesce("name", F.lit("")).alias("name"), "cc", "km")


def fold(name: Column) -> Column:
    """Case- and accent-insensitive form of a name, for equality joins."""
    return F.collate(F.trim(name), "UNICODE_CI_AI")


def places_named(labels: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """Places called like the label's place within ``km`` of its pin, by classes.

    Labels carry ``cell_id``, ``lat``, ``lon`` and ``place``. Labels of one name at one spot are one class, and so are places
    of one name and country at one spot; a row is a pair of classes: the label's ``_fold``, ``y`` and ``x``, the smallest
    ``place_id``, ``cc``, ``km`` and how many ``places`` the class has. ``label_class`` says which class a label is in.
    """
    asked = label_class(labels).select("_fold", "y", "x").distinct()
    known = places.select("place_id", "cc", F.col("lat").alias("py"), F.col("lon").alias("px"), fold(F.col("name")).alias("_fold"))
    known = known.groupBy("_fold", "py", "px", "cc").agg(F.min("place_id").alias("place_id"), F.count(F.lit(1)).alias("places"))
    return within_radius(asked, known, km, on=["_fold"]).select("_fold", "y", "x", "place_id", "cc", "km", "places")


def label_class(labels: DataFrame) -> DataFrame:
    """Labels with their folded place and pin, the key of ``places_named``."""
    return labels.withColumns({"y": F.col("lat"), "x": F.col("lon"), "_fold": fold(F.col("place"))})


def country_agreement(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """Per label: matches found, whether one lies in the label's country, the nearest one's country."""
    found = matches.groupBy("_fold", "y", "x").agg(
        F.sum("places").alias("matches"),
        F.collect_set("cc").alias("_ccs"),  # at most one entry per country
        F.min_by("cc", F.struct("km", "place_id")).alias("nearest_cc"),
    )
    joined = label_class(labels).join(found, ["_fold", "y", "x"], "left").drop("_fold", "y", "x")
    return joined.withColumn("matches", F.coalesce("matches", F.lit(0))).withColumn(
        "agrees", F.when(F.col("_ccs").isNotNull(), F.array_contains("_ccs", F.col("country")))
    ).drop("_ccs")


def snap_to_land(targets: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest land point of the target's tile by index distance, row-major on ties.

    ``land_row`` and ``land_col`` are null where the whole tile is water.
    """
    asked = targets.withColumn("y", F.col("row").cast("double")).withColumn("x", F.col("col").cast("double"))
    land = points.where("land").select(
        "tile", F.col("row").alias("land_row"), F.col("col").alias("land_col"),
        F.col("row").cast("double").alias("py"), F.col("col").cast("double").alias("px"),
    )
    found = nearest(
        asked, land, ["cell_id", "tile"], ["land_row", "land_col"], Plane(), sizes=(1.0, 2.0, 4.0, 16.0), summary_size=10.0,
        within=["tile"], tie=["land_row", "land_col"],
    )
    return found.withColumnRenamed("dist", "steps").drop("y", "x")


def snap_audit(targets: DataFrame, points: DataFrame, lat: Column, lon: Column, land_lat: Column, land_lon: Column, rows: int, cols: int) -> DataFrame:
    """How far each target moved, the truly nearest land, and whether another tile may be nearer.

    The coordinate columns are expressions over ``tile``, ``row``/``col`` and
    ``land_row``/``land_col``.
    """
    snapped = snap_to_land(targets, points)
    moved = (F.col("land_row") != F.col("row")) | (F.col("land_col") != F.col("col"))
    km = geo.haversine_km(lat, lon, land_lat, land_lon, geo.EARTH_KM_STUDY)
    edge = F.least("row", F.lit(rows - 1) - F.col("row"), "col", F.lit(cols - 1) - F.col("col"))
    audited = snapped.withColumns(
        {
            "snapped": F.coalesce(moved, F.lit(True)),
            "snap_km": km,
            "no_land": F.col("land_row").isNull(),
            "cross_tile": F.coalesce(moved & (edge < F.col("steps")), F.lit(False)),
        }
    )
    ground = points.where("land").withColumnsRenamed({"row": "land_row", "col": "land_col"}).select(
        "tile", land_lat.alias("py"), land_lon.alias("px"), "land_row", "land_col"
    )
    asked = targets.select("cell_id", "tile", lat.alias("y"), lon.alias("x"))
    true = nearest(asked, ground, ["cell_id", "tile"], ["land_row"], Sphere(geo.EARTH_KM_STUDY), within=["tile"])
    return audited.join(true.select("cell_id", "tile", F.col("dist").alias("min_land_km")), ["cell_id", "tile"], "left")


def snap_candidates(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """Snap every candidate of a search, keep the closest per cell, in the candidates' order.

    Candidates have ``query_id``, ``candidate_id``, ``lat`` and ``lon``.
    """
    snapped = nearest_cell(candidates, cells, "candidate_id", ["cell_id"])
    best = top_row(
        snapped.select("query_id", "cell_id", "candidate_id", "km"), ["query_id", "cell_id"], [-F.col("km"), -F.col("candidate_id")]
    )
    order = Window.partitionBy("query_id").orderBy("candidate_id")
    return best.withColumn("position", F.row_number().over(order))


def zonal_population(pixels: DataFrame) -> DataFrame:
    """People per 0.1 degree cell; negative pixels mean no data."""
    people = F.when(F.col("pop") < 0, F.lit(0.0)).otherwise(F.coalesce("pop", F.lit(0.0)))
    return pixels.groupBy(snap(F.col("lat")).alias("lat"), snap(F.col("lon")).alias("lon")).agg(F.sum(people).alias("population"))


def tile_budget(cells: DataFrame, years: int, variables: int, chunks_per_year: int = 7) -> DataFrame:
    """Tiles, cells per tile and the request estimate of a full fetch."""
    counted = cells.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    # counts of equal size first: the ordered frame has one row per distinct count
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("_seen", F.sum("m").over(upto))
    totals = counted.agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("cells"), F.max("n").alias("most"), F.min("n").alias("least"))
    middle = ranked.join(F.broadcast(totals)).where(F.col("_seen") > F.floor(F.col("tiles") / 2))
    return middle.groupBy("tiles", "cells", "most", "least").agg(F.max("n").alias("median")).withColumn(
        "requests", F.col("tiles") * F.lit(years * variables * chunks_per_year)
    )


def servable(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Requests marked by whether their snapped coordinate is a known cell."""
    known = cells.select(geo.cell_key(F.col("lat"), F.col("lon")).alias("cell_key")).distinct().withColumn("servable", F.lit(True))
    keyed = requests.withColumn("cell_key", geo.cell_key(half_up(F.col("lat"), 1), half_up(F.col("lon"), 1)))
    return keyed.join(known, "cell_key", "left").withColumn("servable", F.coalesce("servable", F.lit(False)))
