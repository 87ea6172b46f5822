"""Tier merges, joins of the pair frame and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions import derive
from isotherm.functions.rounding import half_up, r6
from isotherm.operators import calibrate, cells, daily, pairs, pools, tiers
from isotherm.operators.keyed import top_row
from isotherm.plans.registry import query
from isotherm.schemas import DELTA_COLUMNS

VALUES = ["tmax_C", "tmin_C", "precip_mm", "wind_max_ms"]
_WIND = "R6(wind_max_ms) AS wind_max_ms"


def wind6(df):
    return df.withColumn("wind_max_ms", r6(F.col("wind_max_ms")))


MERGED = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cell_key, date
   ORDER BY CASE tier WHEN 'archive' THEN 0 WHEN 'recent' THEN 1 ELSE 2 END) AS rn FROM tier_rows) WHERE rn = 1)"""


@query("merge_tiers", f"SELECT cell_key, date, tmax_C, tmin_C, precip_mm, {_WIND}, tier FROM {MERGED}")
def merge_tiers(db):
    return wind6(tiers.merge_tiers(db.tier_rows))


@query("union_tiers", f"SELECT cell_key, date, tmax_C, tmin_C, precip_mm, {_WIND}, tier FROM tier_rows")
def union_tiers(db):
    parts = [db.tier_rows.where(F.col("tier") == t) for t in ("archive", "recent", "forecast")]
    return wind6(tiers.union_tiers(*parts))


@query(
    "upsert_by_date",
    """SELECT coalesce(n.cell_key, o.cell_key) AS cell_key, coalesce(n.date, o.date) AS date, coalesce(n.tmax_C, o.tmax_C) AS tmax_C,
              coalesce(n.precip_mm, o.precip_mm) AS precip_mm
       FROM (SELECT * FROM tier_rows WHERE tier = 'recent') n FULL JOIN (SELECT * FROM tier_rows WHERE tier = 'archive') o
         ON n.cell_key = o.cell_key AND n.date = o.date""",
)
def upsert_by_date(db):
    columns = ["cell_key", "date", "tmax_C", "precip_mm"]
    old = db.tier_rows.where("tier = 'archive'").select(*columns)
    new = db.tier_rows.where("tier = 'recent'").select(*columns)
    return tiers.upsert_by_date(old, new)


@query(
    "merge_columns",
    """WITH o AS (SELECT cell_key, date, tmax_C, precip_mm, tmin_C AS dewpt_mean_C FROM tier_rows WHERE tier = 'archive'),
      n AS (SELECT cell_key, date, CASE WHEN tmax_C > 30 THEN tmax_C END AS tmax_C, precip_mm FROM tier_rows WHERE tier = 'recent')
      SELECT coalesce(n.cell_key, o.cell_key) AS cell_key, coalesce(n.date, o.date) AS date, coalesce(n.tmax_C, o.tmax_C) AS tmax_C,
             coalesce(n.precip_mm, o.precip_mm) AS precip_mm, dewpt_mean_C FROM n FULL JOIN o ON n.cell_key = o.cell_key AND n.date = o.date""",
)
def merge_columns(db):
    old = db.tier_rows.where("tier = 'archive'").select("cell_key", "date", "tmax_C", "precip_mm", F.col("tmin_C").alias("dewpt_mean_C"))
    new = db.tier_rows.where("tier = 'recent'").select(
        "cell_key", "date", F.when(F.col("tmax_C") > 30, F.col("tmax_C")).alias("tmax_C"), "precip_mm"
    )
    return tiers.merge_columns(old, new)


@query(
    "join_sources",
    f"""SELECT t.cell_key, t.date, CASE WHEN tmax_C < 45 THEN tmax_C END AS tmax_C, CASE WHEN tmin_C > 2 THEN tmin_C END AS tmin_C, p.precip_mm, R6(p.wind_max_ms) AS wind_max_ms
       FROM cell_day t LEFT JOIN (SELECT cell_key, date, precip_mm, wind_max_ms FROM cell_day WHERE precip_mm > 0) p ON t.cell_key = p.cell_key AND t.date = p.date
       WHERE tmax_C < 45 OR tmin_C > 2""",
)
def join_sources(db):
    temperature = db.cell_day.select(
        "cell_key", "date", F.when(F.col("tmax_C") < 45, F.col("tmax_C")).alias("tmax_C"), F.when(F.col("tmin_C") > 2, F.col("tmin_C")).alias("tmin_C")
    )
    return wind6(tiers.join_sources(temperature, db.cell_day.where("precip_mm > 0")))


@query("pair_truth_forecast", "SELECT cell_key, date, R6(era5_tmax) AS era5_tmax, R6(hres_tmax) AS hres_tmax FROM pairs_wide WHERE era5_tmax > 20 AND hres_tmax > 25")
def pair_truth_forecast(db):
    truth = db.pairs_wide.where("era5_tmax > 20").select("cell_key", "date", F.col("era5_tmax").alias("tmax"))
    forecast = db.pairs_wide.where("hres_tmax > 25").select("cell_key", "date", F.col("hres_tmax").alias("tmax"))
    joined = pairs.pair(truth, forecast, ["tmax"])
    return joined.select("cell_key", "date", r6(F.col("era5_tmax")).alias("era5_tmax"), r6(F.col("hres_tmax")).alias("hres_tmax"))


@query(
    "attach_static",
    """SELECT p.cell_key, p.date, elevation - hres_elevation AS elev_diff_m,
          R6(2 * 6371.0088::DOUBLE * asin(sqrt(sin(radians(hres_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(hres_lat)) * sin(radians(hres_lon - lon) / 2) ** 2))) AS dist_to_hres_km,
          (SELECT count(*) FROM (SELECT DISTINCT cell_key FROM pairs) q WHERE q.cell_key NOT IN (SELECT cell_key FROM static)) AS uncovered
       FROM pairs p LEFT JOIN static s ON p.cell_key = s.cell_key""",
)
def attach_static(db):
    gaps = pairs.uncovered(db.pairs, db.static).agg(F.count(F.lit(1)).alias("uncovered"))
    rows = pairs.attach_static(db.pairs, db.static).select("cell_key", "date", "elev_diff_m", r6(F.col("dist_to_hres_km")).alias("dist_to_hres_km"))
    return rows.join(F.broadcast(gaps))


@query(
    "asof_version",
    """SELECT cell_key, p.date, v.version FROM pairs p ASOF JOIN (VALUES (DATE '1900-01-01', 'v1'), (DATE '1998-01-01', 'v2'), (DATE '2000-06-01', 'v3')) v(change_date, version)
       ON p.date >= v.change_date""",
)
def asof_version(db):
    changes = db.spark.createDataFrame([("1900-01-01", "v1"), ("1998-01-01", "v2"), ("2000-06-01", "v3")], "change_date STRING, version STRING")
    listed = changes.select(F.col("change_date").cast("date").alias("change_date"), "version")
    # the change list is a parameter: one array of it rides along with every row
    packed = listed.agg(F.array_sort(F.collect_list(F.struct("change_date", "version"))).alias("_c"))
    in_force = F.element_at(F.filter("_c", lambda c: c["change_date"] <= F.col("date")), -1)["version"]
    return db.pairs.join(F.broadcast(packed)).select("cell_key", "date", in_force.alias("version"))


GRID_SQL = """(SELECT cell_key, doy, hres, {cols} FROM (
   SELECT a.cell_key, a.hres, d.doy, m.q FROM (
     SELECT cell_key, unnest(list_distinct(list_transform(range(0, 15), lambda i: round_even(CASE WHEN i = 14 THEN hi ELSE lo + i * ((hi - lo) / 14) END, 2)))) AS hres
     FROM (SELECT cell_key, min(hres) AS lo, max(hres) AS hi FROM pairs GROUP BY 1)) a
   CROSS JOIN (SELECT CAST(1 + 7 * range AS INT) AS doy FROM range(0, 53)) d
   JOIN (SELECT cell_key, month(date) AS mo, quantile_cont(era5 - hres, [0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99]) AS q FROM pairs GROUP BY 1, 2) m
     ON a.cell_key = m.cell_key AND m.mo = month(DATE '2001-01-01' + d.doy - 1)))""".replace(
    "{cols}", ", ".join(f"floor((q[{i + 1}] + hres / 100) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS {c}" for i, c in enumerate(DELTA_COLUMNS))
)


def month_surface(db):
    """A lookup surface: monthly residual quantiles that lean with the forecast value."""
    levels = F.array(*[F.lit(p) for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)])
    months = db.pairs.groupBy("cell_key", F.month("date").alias("month")).agg(F.percentile(F.col("era5") - F.col("hres"), levels).alias("q"))
    points = calibrate.grid(calibrate.value_anchors(db.pairs, "hres", rain=False))
    month = F.month(F.date_add(F.lit("2001-01-01").cast("date"), F.col("doy") - 1))
    joined = points.withColumn("month", month).join(months, ["cell_key", "month"])
    heads = [half_up(F.col("q")[i] + F.col("hres") / 100, 2).alias(c) for i, c in enumerate(DELTA_COLUMNS)]
    return joined.select("cell_key", F.lit("tmax").alias("var"), "doy", "hres", *heads)


def corner_sum(col):
    return (
        f"R6((1 - dw) * ((1 - tw) * (SELECT {col} FROM g WHERE g.cell_key = q.cell_key AND g.doy = q.d0 AND g.hres = q.h0) + tw * (SELECT {col} FROM g WHERE g.cell_key = q.cell_key AND g.doy = q.d0 AND g.hres = q.h1)) "
        f"+ dw * ((1 - tw) * (SELECT {col} FROM g WHERE g.cell_key = q.cell_key AND g.doy = q.d1 AND g.hres = q.h0) + tw * (SELECT {col} FROM g WHERE g.cell_key = q.cell_key AND g.doy = q.d1 AND g.hres = q.h1))) AS {col}"
    )


@query(
    "bilinear_lookup",
    f"""WITH g AS MATERIALIZED (SELECT * FROM {GRID_SQL}),
      ax AS (SELECT cell_key, list_sort(list(DISTINCT hres)) AS hs, list_sort(list(DISTINCT doy)) AS ds FROM g GROUP BY 1),
      q AS MATERIALIZED (SELECT *, CASE WHEN h1 = h0 THEN 0 ELSE (v - h0) / (h1 - h0) END AS tw,
                   (CASE WHEN day >= d0 THEN day - d0 ELSE day - d0 + 365 END) % 365 / (CASE WHEN (d1 - d0 + 365) % 365 = 0 THEN 1 ELSE (d1 - d0 + 365) % 365 END)::DOUBLE AS dw FROM (
            SELECT *, hs[greatest(k, 1)] AS h0, hs[k + 1] AS h1, coalesce(list_max(list_filter(ds, lambda d: d <= day)), ds[-1]) AS d0,
                   coalesce(list_min(list_filter(ds, lambda d: d >= day)), ds[1]) AS d1 FROM (
              SELECT *, len(list_filter(hs, lambda a: a < v)) AS k FROM (
                SELECT p.cell_key, p.date, CAST(dayofyear(p.date) AS INT) AS day, hs, ds, least(greatest(p.hres + 5, hs[1]), hs[-1]) AS v
                FROM pairs p JOIN ax ON p.cell_key = ax.cell_key))))
      SELECT q.cell_key, q.date, {", ".join(corner_sum(c) for c in ("d01", "dmid", "d99"))} FROM q""",
)
def bilinear_lookup(db):
    requests = db.pairs.select(
        "cell_key", "date", F.lit("tmax").alias("var"), F.dayofyear("date").alias("doy"), (F.col("hres") + 5).alias("value")
    )
    found = calibrate.bilinear_lookup(requests, month_surface(db), ["cell_key", "date"])
    return found.select("cell_key", "date", *[r6(F.col(c)).alias(c) for c in ("d01", "dmid", "d99")])


EDGES_SQL = """(SELECT list_concat([1.0::DOUBLE], list_distinct(list_filter(quantile_cont(hres, [0.2, 0.4, 0.6, 0.75, 0.87, 0.95]), lambda e: e > 1))) AS edges
   FROM wet_pairs WHERE hres >= 1)"""


@query(
    "bin_lookup",
    f"""WITH b AS (SELECT cell_key, date, hres, era5, len(list_filter(edges, lambda e: e <= hres)) AS bin FROM wet_pairs, {EDGES_SQL}),
      t AS (SELECT bin, count(*) AS bin_days FROM b GROUP BY 1)
      SELECT cell_key, date, b.bin, bin_days FROM b JOIN t ON b.bin = t.bin""",
)
def bin_lookup(db):
    edges = calibrate.rain_edges(db.wet_pairs)
    binned = db.wet_pairs.join(F.broadcast(edges)).withColumn("bin", derive.search_bin(F.col("edges"), F.col("hres")))
    table = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("bin_days"))
    return calibrate.bin_join(db.wet_pairs, edges, table, "hres").select("cell_key", "date", "bin", "bin_days")


@query("validated_join", "SELECT cell_key, date, R6(era5) AS truth, R6(hres) AS forecast FROM pairs")
def validated_join(db):
    left = db.pairs.select("cell_key", "date", r6(F.col("era5")).alias("truth"))
    right = db.pairs.select("cell_key", "date", r6(F.col("hres")).alias("forecast"))
    return pairs.validated_join(left, right, ["cell_key", "date"])


@query(
    "remap_keys",
    """SELECT CASE WHEN s.elevation < 1500 THEN concat('moved_', d.cell_key) ELSE d.cell_key END AS cell_key, d.date, d.tmax_C
       FROM cell_day d JOIN static s ON d.cell_key = s.cell_key WHERE s.elevation < 2700""",
)
def remap_keys(db):
    moves = db.static.where("elevation < 1500").select(F.col("cell_key").alias("old_key"), F.concat(F.lit("moved_"), "cell_key").alias("new_key"))
    drops = db.static.where("elevation >= 2700")
    return tiers.remap_keys(db.cell_day.select("cell_key", "date", "tmax_C"), moves, drops)


@query(
    "frame_compare",
    """WITH o AS (SELECT cell_key, date, tmax_C, precip_mm FROM tier_rows WHERE tier = 'archive'), n AS (SELECT cell_key, date, tmax_C, precip_mm FROM tier_rows WHERE tier = 'recent'),
      j AS (SELECT o.cell_key, 'tmax_C' AS "column", abs(o.tmax_C - n.tmax_C) AS d FROM o JOIN n ON o.cell_key = n.cell_key AND o.date = n.date
            UNION ALL SELECT o.cell_key, 'precip_mm', abs(o.precip_mm - n.precip_mm) FROM o JOIN n ON o.cell_key = n.cell_key AND o.date = n.date)
      SELECT cell_key, "column", count(*) AS days, count_if(d > 5e-4) AS differing, max(CASE WHEN d > 5e-4 THEN d END) AS max_diff, count(*) >= 10 AS enough FROM j GROUP BY 1, 2""",
)
def frame_compare(db):
    old = db.tier_rows.where("tier = 'archive'")
    return tiers.frame_compare(old, db.tier_rows.where("tier = 'recent'"), ["tmax_C", "precip_mm"], least=10)


@query("orphans", "SELECT cell_key, count(*) AS days FROM cell_day WHERE cell_key NOT IN (SELECT cell_key FROM static WHERE elevation < 2000) GROUP BY 1")
def orphans(db):
    stored = db.cell_day.groupBy("cell_key").agg(F.count(F.lit(1)).alias("days"))
    return stored.join(db.static.where("elevation < 2000"), "cell_key", "left_anti")


@query(
    "semi_cells",
    """WITH f AS (SELECT DISTINCT cell_key FROM cell_day WHERE tier = 'forecast' AND tmax_C > 49)
      SELECT cell_key, cell_key IN (SELECT cell_key FROM f) AS has_forecast FROM (SELECT DISTINCT cell_key FROM cell_day)""",
)
def semi_cells(db):
    cells_ = db.cell_day.select("cell_key").distinct()
    forecast = db.cell_day.where("tier = 'forecast' AND tmax_C > 49").select("cell_key").distinct()
    both = cells_.join(forecast, "cell_key", "left_semi").withColumn("has_forecast", F.lit(True))
    return both.unionByName(cells_.join(forecast, "cell_key", "left_anti").withColumn("has_forecast", F.lit(False)))


@query(
    "missing_dates",
    """WITH e AS (SELECT cell_key, max(date) AS archive_end FROM cell_day WHERE tier = 'archive' GROUP BY 1),
      x AS (SELECT cell_key, CAST(unnest(generate_series(archive_end + 1, DATE '2001-05-10', INTERVAL 1 DAY)) AS DATE) AS date FROM e),
      m AS (SELECT * FROM x ANTI JOIN (SELECT cell_key, date FROM cell_day WHERE tier = 'recent') r USING (cell_key, date))
      SELECT cell_key, date, min(date) OVER (PARTITION BY cell_key) AS first_missing FROM m""",
)
def missing_dates(db):
    ends = db.cell_day.where("tier = 'archive'").groupBy("cell_key").agg(F.max("date").alias("archive_end"))
    gaps = tiers.missing_dates(db.cell_day.where("tier = 'recent'"), ends, F.lit("2001-05-10").cast("date"))
    first = gaps.groupBy("cell_key").agg(F.min("date").alias("first_missing"))
    return gaps.join(first, "cell_key")


@query(
    "history_theta",
    """WITH t AS (SELECT cell_key, date FROM cell_day WHERE tier = 'forecast'),
      p AS (SELECT t.cell_key, t.date, h.tmax_C AS v, h.date BETWEEN a - 3 AND a + 3 AS win
            FROM t JOIN cell_day h ON t.cell_key = h.cell_key AND h.date < t.date,
                 LATERAL (SELECT make_date(year(h.date), month(t.date), 1) + CAST(day(t.date) - 1 AS INT) AS a))
      SELECT cell_key, date, count(*) AS n_all, count_if(win) AS n_win, list_sort(list(v), 'DESC')[10] AS tenth, max(v) AS hottest, min(v) AS coldest,
             R6(avg(CASE WHEN win THEN v END)) AS window_mean FROM p GROUP BY 1, 2""",
)
def history_theta(db):
    targets = db.cell_day.where("tier = 'forecast'")
    found = pools.history_pools(db.cell_day, targets, "tmax_C")
    mean = F.aggregate("window", F.lit(0.0), lambda a, v: a + v) / F.size("window")
    return found.select(
        "cell_key", "date", "n_all", F.size("window").alias("n_win"), F.get("top", 9).alias("tenth"), F.get("top", 0).alias("hottest"),
        F.get("bottom", 0).alias("coldest"), r6(F.when(F.size("window") > 0, mean)).alias("window_mean"),
    )


@query(
    "gate_split",
    """WITH g AS (SELECT cell_key FROM pairs GROUP BY 1 HAVING avg(abs(era5 - hres + 2.6::DOUBLE)) > 0.95)
      SELECT cell_key, date, CASE WHEN cell_key IN (SELECT cell_key FROM g) THEN 'empirical' ELSE 'model' END AS route FROM pairs""",
)
def gate_split(db):
    scores = db.pairs.groupBy("cell_key").agg(F.avg(F.abs(F.col("era5") - F.col("hres") + 2.6)).alias("mae"))
    rows = calibrate.gate_split(db.pairs, scores.where("mae > 0.95"), ["cell_key"])
    return rows.select("cell_key", "date", "route")


@query(
    "feed_gap",
    """WITH g AS (SELECT o.cell_key, abs(o.wind_max_ms - n.wind_max_ms * 1.01::DOUBLE) AS gap FROM (SELECT * FROM tier_rows WHERE tier = 'archive') o
                 JOIN (SELECT * FROM tier_rows WHERE tier = 'recent') n ON o.cell_key = n.cell_key AND o.date = n.date)
      SELECT count(*) AS rows, R6(100 * avg(CASE WHEN gap > 0.6 THEN 1.0 ELSE 0.0 END)) AS differ_pct, R6(avg(gap)) AS mean_gap, R6(quantile_cont(gap, 0.99)) AS p99_gap FROM g""",
)
def feed_gap(db):
    from isotherm.operators.order_stats import quantiles

    old = db.tier_rows.where("tier = 'archive'")
    new = db.tier_rows.where("tier = 'recent'").withColumn("wind_max_ms", F.col("wind_max_ms") * 1.01)
    gaps = pairs.feed_gap(old, new, "wind_max_ms", 0.6)
    means = gaps.agg(
        F.count(F.lit(1)).alias("rows"), r6(100 * F.avg(F.col("differs").cast("double"))).alias("differ_pct"), r6(F.avg("gap")).alias("mean_gap")
    )
    p99 = quantiles(gaps, [], "gap", [0.99]).select(r6(F.col("q")[0]).alias("p99_gap"))
    return means.join(F.broadcast(p99))


MOVERS_SQL = """(SELECT c.cell_id, c.name, c.population, c.lat, c.lon,
    CASE WHEN c.population < 60000 THEN n.lat ELSE floor(c.lat / 30) * 30 + 0.1 END AS new_lat,
    CASE WHEN c.population < 60000 THEN n.lon ELSE floor(c.lon / 60) * 60 + 0.1 END AS new_lon, c.population % 4000 / 100.0::DOUBLE AS snap_km
  FROM cells c JOIN cells n ON n.cell_id = c.cell_id + 1 WHERE c.population < 150000)"""


def movers(db):
    nxt = db.cells.select((F.col("cell_id") - 1).alias("cell_id"), F.col("lat").alias("_nlat"), F.col("lon").alias("_nlon"))
    onto = F.col("population") < 60000
    return db.cells.where("population < 150000").join(nxt, "cell_id").select(
        "cell_id", "name", "population", "lat", "lon",
        F.when(onto, F.col("_nlat")).otherwise(F.floor(F.col("lat") / 30) * 30 + 0.1).alias("new_lat"),
        F.when(onto, F.col("_nlon")).otherwise(F.floor(F.col("lon") / 60) * 60 + 0.1).alias("new_lon"),
        (F.col("population") % 4000 / 100.0).alias("snap_km"),
    )


def _tile(lat, lon):
    lon360 = f"(CASE WHEN {lon} < 0 THEN {lon} + 360 ELSE {lon} END)"
    return f"concat(CAST(floor(round_even((90 - {lat}) / 0.1::DOUBLE, 0) / 50) AS BIGINT), '_', CAST(floor(round_even({lon360} / 0.1::DOUBLE, 0) / 100) AS BIGINT))"


PLAN_SQL = f"""(WITH m AS MATERIALIZED (SELECT * FROM {MOVERS_SQL}),
   s AS (SELECT * FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM m)),
   k AS (SELECT new_lat, new_lon, cell_id AS kid, name AS kname, population AS kpop FROM (
         SELECT *, row_number() OVER (PARTITION BY new_lat, new_lon ORDER BY population DESC, cell_id) AS rn FROM m) WHERE rn = 1)
   SELECT m.cell_id, m.name, m.population, m.lat, m.lon, m.new_lat, m.new_lon, m.snap_km,
     CASE WHEN s.cell_id IS NOT NULL THEN 'drop_dup_existing' WHEN kid <> m.cell_id THEN 'drop_dup_moved'
          WHEN round_even(m.lon / 15, 0) <> round_even(m.new_lon / 15, 0) THEN 'move_repull' ELSE 'move' END AS action,
     CASE WHEN s.cell_id IS NOT NULL THEN s.cell_id WHEN kid <> m.cell_id THEN kid END AS merge_into,
     CASE WHEN s.cell_id IS NOT NULL THEN CASE WHEN m.snap_km <= 25 AND m.population >= s.population THEN m.name ELSE s.name END WHEN kid <> m.cell_id THEN kname END AS survivor_name,
     CASE WHEN s.cell_id IS NOT NULL THEN greatest(m.population, s.population) WHEN kid <> m.cell_id THEN kpop END AS survivor_population,
     round_even(m.lon / 15, 0) <> round_even(m.new_lon / 15, 0) AS offset_flip,
     {_tile("m.lat", "m.lon")} <> {_tile("m.new_lat", "m.new_lon")} AS tile_changed
   FROM m LEFT JOIN s ON s.lat = m.new_lat AND s.lon = m.new_lon JOIN k ON k.new_lat = m.new_lat AND k.new_lon = m.new_lon)"""

PLAN_COLUMNS = ["cell_id", "action", "merge_into", "survivor_name", "survivor_population", "offset_flip", "tile_changed"]


@query("snap_plan", f"SELECT {', '.join(PLAN_COLUMNS)} FROM {PLAN_SQL}")
def snap_plan(db):
    return cells.snap_plan(movers(db), db.cells).select(*PLAN_COLUMNS)


@query(
    "apply_plan",
    f"""WITH p AS MATERIALIZED (SELECT * FROM {PLAN_SQL}),
      sv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merge_into ORDER BY survivor_population DESC, cell_id) AS rn FROM p WHERE action LIKE 'drop%') WHERE rn = 1)
      SELECT c.cell_id, coalesce(sv.survivor_name, c.name) AS name, coalesce(mv.new_lat, c.lat) AS lat, coalesce(mv.new_lon, c.lon) AS lon,
             greatest(c.population, coalesce(sv.survivor_population, 0)) AS population, {_tile("coalesce(mv.new_lat, c.lat)", "coalesce(mv.new_lon, c.lon)")} AS tile_id
      FROM cells c LEFT JOIN (SELECT * FROM p WHERE action LIKE 'move%') mv ON c.cell_id = mv.cell_id LEFT JOIN sv ON sv.merge_into = c.cell_id
      WHERE c.cell_id NOT IN (SELECT cell_id FROM p WHERE action LIKE 'drop%')""",
)
def apply_plan(db):
    plan = cells.snap_plan(movers(db), db.cells)
    return cells.apply_plan(db.cells, plan).select("cell_id", "name", "lat", "lon", "population", "tile_id")


@query(
    "plan_counts",
    f"""WITH p AS MATERIALIZED (SELECT * FROM {PLAN_SQL})
      SELECT action, count(*) AS n, count_if(offset_flip) AS offset_flips, count_if(tile_changed) AS tile_changes, count_if(m > 1) AS shared_destinations
      FROM p JOIN (SELECT new_lat, new_lon, count(*) AS m FROM p GROUP BY 1, 2) d ON p.new_lat = d.new_lat AND p.new_lon = d.new_lon GROUP BY 1""",
)
def plan_counts(db):
    return cells.plan_counts(cells.snap_plan(movers(db), db.cells))


QM_SQL = """(SELECT p.cell_key, p.date, p.era5, p.hres, p.season, p.fc_version, p.dec, p.dec1, p.role,
   CASE WHEN i = 0 THEN qe[1] WHEN i >= 101 THEN qe[101] ELSE qe[i] + (p.hres - qh[i]) / (qh[i + 1] - qh[i]) * (qe[i + 1] - qe[i]) END AS mapped
   FROM (SELECT p.*, m.qh, m.qe, len(list_filter(m.qh, lambda q: q <= p.hres)) AS i FROM labelled p JOIN (
     SELECT cell_key, quantile_cont(hres, list_transform(range(0, 101), lambda k: k / 100.0)) AS qh, quantile_cont(era5, list_transform(range(0, 101), lambda k: k / 100.0)) AS qe
     FROM labelled WHERE role = 'train' GROUP BY 1) m ON p.cell_key = m.cell_key WHERE p.role = 'test') p)"""
_QM_LEVELS = "[" + ", ".join(str(k / 100) for k in range(101)) + "]"
QM_SQL = QM_SQL.replace("list_transform(range(0, 101), lambda k: k / 100.0)", _QM_LEVELS)


@query("quantile_map", f"SELECT cell_key, date, R6(mapped) AS mapped FROM {QM_SQL}")
def quantile_map(db):
    rows = calibrate.quantile_map(db.roles.where("role = 'train'"), db.roles.where("role = 'test'"))
    return rows.select("cell_key", "date", r6(F.col("mapped")).alias("mapped"))


DAILY_SQL = """(WITH i AS (SELECT cell_key, ts, t2m, sqrt(u10 * u10 + v10 * v10) AS wind,
      greatest(coalesce(CASE WHEN hour(ts) = 1 THEN tp ELSE tp - lag(tp) OVER (PARTITION BY cell_key, CAST(ts - INTERVAL 1 HOUR AS DATE) ORDER BY ts) END, 0), 0) AS incr FROM hourly)
   SELECT cell_key, CAST(ts + INTERVAL (off) HOUR AS DATE) AS date, (round_even((max(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS tmax_C, (round_even((min(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS tmin_C,
          (round_even((sum(incr) * 1000) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS precip_mm, (round_even((max(wind)) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS wind_max_ms, count(*) AS hours
   FROM (SELECT i.*, CAST(round_even(lon / 15, 0) AS INT) AS off FROM i JOIN static s ON s.cell_key = i.cell_key) GROUP BY 1, 2 HAVING count(*) = 24)"""


@query("deaccumulate", """SELECT cell_key, ts, R6(1000 * greatest(coalesce(CASE WHEN hour(ts) = 1 THEN tp
    ELSE tp - lag(tp) OVER (PARTITION BY cell_key, CAST(ts - INTERVAL 1 HOUR AS DATE) ORDER BY ts) END, 0), 0)) AS mm FROM hourly""")
def deaccumulate(db):
    return daily.deaccumulate(db.hourly).select("cell_key", "ts", r6(F.col("tp_incr") * 1000).alias("mm"))


@query("daily_metrics", f"SELECT cell_key, date, R6(tmax_C) AS tmax_C, R6(tmin_C) AS tmin_C, R6(precip_mm) AS precip_mm, R6(wind_max_ms) AS wind_max_ms, hours FROM {DAILY_SQL}")
def daily_metrics(db):
    return complete_days(db).select("cell_key", "date", *[r6(F.col(c)).alias(c) for c in VALUES], "hours")


def complete_days(db):
    offsets = daily.local_offset(db.static).select("cell_key", "offset_h")
    rows = daily.hourly_wind(daily.deaccumulate(db.hourly)).join(offsets, "cell_key")
    return daily.daily_metrics(daily.with_local_day(rows, F.col("offset_h")))


COVERAGE_SQL = """(WITH y AS (SELECT cell_key, year(date) AS year, count(*) AS rows FROM cell_day GROUP BY 1, 2),
    c AS (SELECT cell_key, concat('t', CAST(substr(cell_key, 2) AS INT) // 2) AS tile_id FROM static),
    t AS (SELECT tile_id, count(*) AS cells, min(newest) AS newest FROM c LEFT JOIN (SELECT cell_key, max(date) AS newest FROM cell_day GROUP BY 1) n ON n.cell_key = c.cell_key
          GROUP BY 1 HAVING bool_and(newest IS NOT NULL))
    SELECT c.tile_id, y.year, CASE WHEN count(*) < any_value(t.cells) THEN 0 ELSE min(rows) END AS rows, any_value(t.newest) AS newest
    FROM c JOIN y ON c.cell_key = y.cell_key JOIN t ON t.tile_id = c.tile_id GROUP BY 1, 2)"""


def tiled(db):
    number = F.substring("cell_key", 2, 10).cast("int")
    return db.static.select("cell_key", F.concat(F.lit("t"), F.floor(number / 2)).alias("tile_id"))


@query("coverage_by_year", f"SELECT * FROM {COVERAGE_SQL}")
def coverage_by_year(db):
    return tiers.coverage_by_year(db.cell_day, tiled(db))


LATEST = "2001-11-04"
MISSING_SQL = f"""(SELECT t.tile_id, y.year FROM (SELECT DISTINCT concat('t', CAST(substr(cell_key, 2) AS INT) // 2) AS tile_id FROM static) t, (SELECT CAST(range AS INT) AS year FROM range(1990, 2003)) y
    WHERE NOT EXISTS (SELECT 1 FROM {COVERAGE_SQL} v WHERE v.tile_id = t.tile_id AND v.year = y.year
      AND rows >= CASE WHEN v.year < 2001 THEN dayofyear(make_date(v.year, 12, 31)) WHEN v.year = 2001 THEN dayofyear(DATE '{LATEST}') END - 12))"""


def missing(db):
    return tiers_missing(db, 12)


def tiers_missing(db, slack):
    latest = F.lit(LATEST).cast("date")
    coverage = tiers.coverage_by_year(db.cell_day, tiled(db))
    wanted = tiled(db).select("tile_id").distinct().withColumn("year", F.explode(F.sequence(F.lit(1990), F.lit(2002))))
    return wanted.join(tiers.complete_years(coverage, latest, slack), ["tile_id", "year"], "left_anti")


@query("missing_years", MISSING_SQL[1:-1])
def missing_years(db):
    return missing(db)


@query(
    "year_spans",
    f"""WITH m AS ({MISSING_SQL[1:-1]}), i AS (SELECT tile_id, year, year - row_number() OVER (PARTITION BY tile_id ORDER BY year) AS g FROM m),
      p AS (SELECT *, (year - min(year) OVER (PARTITION BY tile_id, g)) // 3 AS part FROM i)
      SELECT tile_id, min(year) AS first_year, max(year) AS last_year FROM p GROUP BY tile_id, g, part""",
)
def year_spans(db):
    return tiers.year_spans(missing(db), 3)


@query("dedupe_last", "SELECT cell_key, date, tmax_C FROM tier_rows WHERE tier = 'forecast' UNION ALL SELECT cell_key, date, tmax_C FROM tier_rows t WHERE tier <> 'forecast' AND NOT EXISTS (SELECT 1 FROM tier_rows f WHERE f.cell_key = t.cell_key AND f.date = t.date AND tmax_C > t.tmax_C)")
def dedupe_last(db):
    # values rise from archive to forecast, so the value serves as the ingestion order
    return tiers.dedupe_last(db.tier_rows.select("cell_key", "date", "tmax_C"), ["cell_key", "date"], "tmax_C")


@query("best_per_group", "SELECT country, cell_id, population FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY population DESC, cell_id) AS rn FROM cells) WHERE rn = 1")
def best_per_group(db):
    return top_row(db.cells.select("country", "cell_id", "population"), ["country"], [F.col("population"), -F.col("cell_id")])


@query("common_dates", "SELECT cell_key, date FROM tier_rows WHERE tier = 'recent' INTERSECT SELECT cell_key, date FROM tier_rows WHERE tier = 'forecast'")
def common_dates(db):
    return tiers.common_dates(db.tier_rows.where("tier = 'recent'"), db.tier_rows.where("tier = 'forecast'"))


@query("years_diff", "SELECT CAST(range AS INT) AS year FROM range(1990, 2005) WHERE range NOT IN (SELECT year(date) FROM cell_day)")
def years_diff(db):
    wanted = db.cell_day.agg(F.lit(1)).select(F.explode(F.sequence(F.lit(1990), F.lit(2004))).alias("year"))
    return wanted.exceptAll(db.cell_day.select(F.year("date").alias("year")).distinct())


@query(
    "staleness",
    """SELECT cell_key, tier, R6(age) AS age_h, age >= ttl AS expired, age >= ttl OR (tier = 'forecast' AND last_date < DATE '2001-11-01') AS refresh FROM (
         SELECT cell_key, tier, max(date) AS last_date, date_diff('second', max(date) + INTERVAL 6 HOUR, TIMESTAMP '2001-11-01 12:00:00') / 3600.0::DOUBLE AS age,
                CASE tier WHEN 'forecast' THEN 12 ELSE 24 END AS ttl FROM cell_day WHERE tier <> 'archive' GROUP BY 1, 2)""",
)
def staleness(db):
    objects = db.cell_day.where("tier <> 'archive'").groupBy("cell_key", "tier").agg(F.max("date").alias("last_date"))
    updated = objects.withColumn("updated_at", F.col("last_date").cast("timestamp") + F.expr("INTERVAL 6 HOURS"))
    rows = tiers.staleness(updated, F.lit("2001-11-01 12:00:00").cast("timestamp"), {"forecast": 12, "recent": 24})
    return rows.select("cell_key", "tier", r6(F.col("age_h")).alias("age_h"), "expired", "refresh")
