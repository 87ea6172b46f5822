"""Spatial joins and sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions import geo, traffic
from isotherm.functions.rounding import r6
from isotherm.operators import spatial
from isotherm.plans.columns import TILE_SQL
from isotherm.plans.registry import query


def haversine_sql(a: str, b: str, c: str, d: str, radius: str = "6371.0") -> str:
    return (
        f"2 * {radius}::DOUBLE * asin(least(1.0, sqrt(sin(radians(({c}) - ({a})) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) "
        f"* sin(radians(({d}) - ({b})) / 2) ** 2)))"
    )


KM = haversine_sql("g.lat", "g.lon", "c.lat", "c.lon")


@query(
    "nearest_cell",
    f"""SELECT place_id, cell_id, R6(km) AS km FROM (
          SELECT g.place_id, c.cell_id, {KM} AS km, row_number() OVER (PARTITION BY g.place_id ORDER BY {KM}, c.cell_id) AS rn
          FROM gazetteer g, cells c) WHERE rn = 1""",
)
def nearest_cell(db):
    found = spatial.nearest_cell(db.gazetteer.select("place_id", "lat", "lon"), db.cells, "place_id", ["cell_id"])
    return found.select("place_id", "cell_id", r6(F.col("km")).alias("km"))


@query(
    "place_lookup",
    """WITH pages AS (SELECT DISTINCT page, CAST(regexp_extract(page, '^/([0-9.]+),', 1) AS DOUBLE) AS lat,
                             CAST(regexp_extract(page, ',([0-9.]+)', 1) AS DOUBLE) AS lon FROM hits),
      spots AS (SELECT DISTINCT lat, lon FROM pages),
      ranked AS (SELECT s.lat, s.lon, c.name, s.lat = c.lat AND s.lon = c.lon AS exact,
             row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY sqrt((c.lat - s.lat) * (c.lat - s.lat) + (c.lon - s.lon) * (c.lon - s.lon)), c.cell_id) AS rn
             FROM spots s, cells c)
      SELECT h.event_id, r.name AS place, r.exact FROM hits h JOIN pages p ON h.page = p.page JOIN ranked r ON r.rn = 1 AND r.lat = p.lat AND r.lon = p.lon""",
)
def place_lookup(db):
    lat, lon = traffic.page_coordinates(F.col("page"))
    points = db.hits.select("event_id", lat.alias("lat"), lon.alias("lon"))
    return spatial.place_lookup(points, db.cells).select("event_id", "place", "exact")


@query(
    "knn_name",
    f"""WITH d AS (SELECT c.cell_id, g.place_id, g.name, g.population, g.cc, {haversine_sql("c.lat", "c.lon", "g.lat", "g.lon")} AS km,
          row_number() OVER (PARTITION BY c.cell_id ORDER BY
             sqrt((radians(g.lon) * cos(radians(g.lat)) - radians(c.lon) * cos(radians(c.lat))) ** 2 + (radians(g.lat) - radians(c.lat)) ** 2), g.place_id) AS rk
          FROM cells c, gazetteer g),
      near AS (SELECT * FROM d WHERE km <= 8),
      lone AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY km, place_id) AS ln FROM d WHERE cell_id NOT IN (SELECT cell_id FROM near)),
      pick AS (SELECT cell_id, name, population, cc, km FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY population DESC, rk) AS pn FROM near) WHERE pn = 1
               UNION ALL SELECT cell_id, name, population, cc, km FROM lone WHERE ln = 1),
      par AS (SELECT cell_id, name FROM (SELECT d.cell_id, d.name, row_number() OVER (PARTITION BY d.cell_id ORDER BY d.population DESC, d.rk) AS pn
              FROM d JOIN pick p ON d.cell_id = p.cell_id WHERE d.km <= 12 AND d.name <> p.name AND d.population >= 4 * greatest(p.population, 1)) WHERE pn = 1)
      SELECT p.cell_id, concat_ws(', ', p.name, par.name) AS name, p.cc, R6(p.km) AS km FROM pick p LEFT JOIN par ON p.cell_id = par.cell_id""",
)
def knn_name(db):
    return spatial.name_cells(db.cells, db.gazetteer).withColumn("km", r6(F.col("km")))


RADIUS_KM = 2500.0
LABELS = "(SELECT cell_id, lat, lon, country, concat('pLACE ', cell_id % 40) AS place FROM cells)"


def labels(db):
    return db.cells.select("cell_id", "lat", "lon", "country", F.concat(F.lit("pLACE "), F.col("cell_id") % 40).alias("place"))


@query(
    "radius_join",
    f"""WITH m AS (SELECT c.cell_id, g.place_id, g.cc, {KM} AS km FROM {LABELS} c JOIN gazetteer g ON lower(c.place) = lower(g.name) WHERE {KM} <= {RADIUS_KM}),
      a AS (SELECT cell_id, count(*) AS matches, list(DISTINCT cc) AS ccs, arg_min(cc, km) AS nearest_cc FROM m GROUP BY 1)
      SELECT c.cell_id, coalesce(matches, 0) AS matches, list_contains(ccs, c.country) AS agrees, nearest_cc FROM cells c LEFT JOIN a ON a.cell_id = c.cell_id""",
)
def radius_join(db):
    matches = spatial.places_named(labels(db), db.gazetteer, RADIUS_KM)
    return spatial.country_agreement(labels(db), matches).select("cell_id", "matches", "agrees", "nearest_cc")


LAND_SNAP = """(SELECT t.cell_id, t.tile, t.row, t.col, g.row AS land_row, g.col AS land_col,
   row_number() OVER (PARTITION BY t.cell_id ORDER BY (g.row - t.row) * (g.row - t.row) + (g.col - t.col) * (g.col - t.col), g.row, g.col) AS rn
   FROM grid_targets t LEFT JOIN gridpoints g ON t.tile = g.tile AND g.land)"""


@query("land_snap", f"SELECT cell_id, land_row, land_col FROM {LAND_SNAP} WHERE rn = 1")
def land_snap(db):
    return spatial.snap_to_land(db.grid_targets, db.gridpoints).select("cell_id", "land_row", "land_col")


_MOVED = "(land_row <> row OR land_col <> col)"
_MOVED_KM = haversine_sql("60 - row / 10", "tile * 10 + col / 10", "60 - land_row / 10", "tile * 10 + land_col / 10", "6371.0088")
_TRUE_KM = haversine_sql("60 - t.row / 10", "t.tile * 10 + t.col / 10", "60 - g.row / 10", "g.tile * 10 + g.col / 10", "6371.0088")


@query(
    "snap_audit",
    f"""SELECT s.cell_id, {_MOVED} AS snapped, R6({_MOVED_KM}) AS snap_km, R6(m.km) AS min_land_km,
          {_MOVED} AND least(row, 49 - row, col, 49 - col) < sqrt((land_row - row) ** 2 + (land_col - col) ** 2) AS cross_tile
        FROM {LAND_SNAP} s JOIN (SELECT t.cell_id, min({_TRUE_KM}) AS km
          FROM grid_targets t JOIN gridpoints g ON t.tile = g.tile AND g.land GROUP BY 1) m ON s.cell_id = m.cell_id WHERE rn = 1""",
)
def snap_audit(db):
    def lat(row):
        return F.lit(60.0) - F.col(row) / 10

    def lon(col):
        return F.col("tile") * 10 + F.col(col) / 10

    audit = spatial.snap_audit(
        db.grid_targets, db.gridpoints, lat("row"), lon("col"), lat("land_row"), lon("land_col"), rows=50, cols=50
    )
    return audit.select("cell_id", "snapped", r6(F.col("snap_km")).alias("snap_km"), r6(F.col("min_land_km")).alias("min_land_km"), "cross_tile")


@query(
    "snap_candidates",
    f"""WITH n AS (SELECT place_id, cell_id, km FROM (SELECT g.place_id, c.cell_id, {KM} AS km, row_number() OVER (PARTITION BY g.place_id ORDER BY {KM}, c.cell_id) AS rn
          FROM gazetteer g, cells c) WHERE rn = 1),
      b AS (SELECT *, place_id // 5 AS query_id, row_number() OVER (PARTITION BY place_id // 5, cell_id ORDER BY km, place_id) AS rn FROM n)
      SELECT query_id, cell_id, place_id AS candidate_id, R6(km) AS km, row_number() OVER (PARTITION BY query_id ORDER BY place_id) AS position FROM b WHERE rn = 1""",
)
def snap_candidates(db):
    found = db.gazetteer.select(F.floor(F.col("place_id") / 5).alias("query_id"), F.col("place_id").alias("candidate_id"), "lat", "lon")
    return spatial.snap_candidates(found, db.cells).withColumn("km", r6(F.col("km")))


@query(
    "zonal_population",
    """SELECT R6(floor(lat * 10 + 0.5) / 10) AS lat, R6(floor(lon * 10 + 0.5) / 10) AS lon, round(sum(CASE WHEN pop < 0 THEN 0 ELSE pop END), 2) AS population
       FROM pixels GROUP BY 1, 2""",
)
def zonal_population(db):
    return spatial.zonal_population(db.pixels).withColumn("population", F.round("population", 2))


@query(
    "tile_budget",
    f"""WITH t AS ({TILE_SQL}), n AS (SELECT tile_id, count(*) AS n FROM t GROUP BY 1)
      SELECT count(*) AS tiles, CAST(sum(n) AS BIGINT) AS cells, max(n) AS most, min(n) AS least,
             list_extract(list_sort(list(n), 'DESC'), CAST(count(*) // 2 AS INT) + 1) AS median, count(*) * 76 * 4 * 7 AS requests FROM n""",
)
def tile_budget(db):
    tiled = db.cells.select(geo.tile(F.col("lat"), F.col("lon"))["tile_id"].alias("tile_id"))
    return spatial.tile_budget(tiled, years=76, variables=4)


@query("land_mask", "SELECT tile, row, col, bool_or(land) AS land FROM gridpoints GROUP BY 1, 2, 3")
def land_mask(db):
    from isotherm.operators.daily import land_points

    readings = db.gridpoints.withColumn("t2m", F.when(F.col("land"), F.lit(280.0)).otherwise(F.lit(float("nan"))))
    return land_points(readings.drop("land"), ["tile", "row", "col"])


@query(
    "servable_filter",
    """SELECT g.place_id, c.k IS NOT NULL AS servable FROM gazetteer g LEFT JOIN (SELECT DISTINCT round(lat * 10) AS a, round(lon * 10) AS b, 1 AS k FROM cells) c
       ON floor(g.lat * 10 + 0.5) = c.a AND floor(g.lon * 10 + 0.5) = c.b""",
)
def servable_filter(db):
    return spatial.servable(db.gazetteer, db.cells).select("place_id", "servable")
