"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions.rounding import half_up, r6
from isotherm.operators import pairs as pair_ops
from isotherm.plans.registry import query
from isotherm.schemas import DELTA_COLUMNS
from isotherm.sources import catalogue, feed, frames, hits, hourly, inventory, surface, tiers

_DAYS = "cell_key, date, tmax_C, tmin_C, precip_mm, R6(wind_max_ms) AS wind_max_ms, tier"


def _days(df):
    return df.withColumn("wind_max_ms", r6(F.col("wind_max_ms")))


@query("scan_tier", f"SELECT {_DAYS} FROM cell_day WHERE tier = 'archive'")
def scan_tier(db):
    path = db.staging("tier")
    tiers.write_tier_objects(db.cell_day, path, "archive")
    return _days(tiers.read_tier(db.spark, path, "archive"))


@query("write_tier", f"SELECT {_DAYS} FROM cell_day")
def write_tier(db):
    path = db.staging("tiers")
    tiers.write_tiers(db.cell_day, path)
    return _days(tiers.read_tiers(db.spark, path))


@query("scan_hourly", "SELECT cell_key AS tile_id, ts, R6(t2m) AS t2m, R6(tp) AS tp FROM hourly")
def scan_hourly(db):
    path = db.staging("hourly")
    hourly.write_hourly(db.hourly.withColumn("tile_id", F.col("cell_key")), path)
    rows = hourly.read_hourly(db.spark, path, 2024, 2024)
    return rows.select("tile_id", "ts", r6(F.col("t2m")).alias("t2m"), r6(F.col("tp")).alias("tp"))


@query(
    "scan_cells",
    """SELECT cell_id, lat, lon, population, concat(name, ', Land "', country, '"') AS name FROM cells
       WHERE population % 50 <> 0""",
)
def scan_cells(db):
    path = db.staging("cells")
    lat = F.when(F.col("population") % 50 == 0, F.lit("n/a")).otherwise(F.col("lat").cast("string"))
    db.cells.select(
        "cell_id", lat.alias("lat"), "lon", "population", F.lit("0_0").alias("tile_id"),
        F.lit(90.0).alias("tile_lat"), F.lit(0.0).alias("tile_lon"),
        F.concat("name", F.lit(', Land "'), "country", F.lit('"')).alias("name"),
    ).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return catalogue.read_cells(db.spark, path).select("cell_id", "lat", "lon", "population", "name")


@query(
    "scan_gazetteer",
    """SELECT name, lat, lon, CAST(cc AS VARCHAR) AS cc,
              CASE WHEN place_id % 7 = 0 THEN 0 ELSE population END AS population
       FROM gazetteer WHERE place_id % 11 <> 0""",
)
def scan_gazetteer(db):
    path = db.staging("gazetteer")
    people = F.when(F.col("place_id") % 7 == 0, F.lit("unknown")).otherwise(F.col("population").cast("string"))
    fields = {1: F.col("name"), 4: F.col("lat").cast("string"), 5: F.col("lon").cast("string"),
              8: F.col("cc").cast("string"), 14: people}
    line = F.concat_ws("\t", *[fields.get(i, F.lit("-")) for i in range(19)])
    short = F.concat_ws("\t", F.lit("x"), F.col("name"))
    db.gazetteer.select(F.when(F.col("place_id") % 11 == 0, short).otherwise(line).alias("value")).write.text(path)
    return catalogue.read_gazetteer(db.spark, path).select("name", "lat", "lon", "cc", "population")


@query(
    "scan_lookup",
    """SELECT c.cell_id, n.n_name AS country FROM cells c JOIN nation n ON c.country = n.n_nationkey""",
)
def scan_lookup(db):
    path = db.staging("lookup")
    nation = db.read("nation")
    lines = F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.lit("-"), F.col("n_name"))
    comments = nation.select(F.concat(F.lit("# code\tx\t"), F.col("n_name")).alias("value"))
    nation.select(lines.alias("value")).unionByName(comments).write.text(path)
    names = catalogue.read_lookup(db.spark, path, 0, 2).withColumnRenamed("name", "country_name")
    return (
        db.cells.withColumn("code", F.col("country").cast("string"))
        .join(names, "code")
        .select("cell_id", F.col("country_name").alias("country"))
    )


@query(
    "explode_daily",
    """SELECT cell_key, date, tmax_C, tmin_C, CASE WHEN precip_mm >= 1 THEN precip_mm END AS precip_mm,
              R6(wind_max_ms) AS wind_max_ms FROM cell_day""",
)
def explode_daily(db):
    day = F.struct("date", "tmax_C", "tmin_C", "precip_mm", "wind_max_ms")
    blocks = db.cell_day.groupBy("cell_key", F.year("date").alias("year")).agg(
        F.array_sort(F.collect_list(day)).alias("d")  # at most 366 days of one cell
    )

    def field(name):
        return F.transform("d", lambda r: r[name])

    daily = F.struct(
        F.transform("d", lambda r: F.date_format(r["date"], "yyyy-MM-dd")).alias("time"),
        field("tmax_C").alias("temperature_2m_max"),
        field("tmin_C").alias("temperature_2m_min"),
        F.transform("d", lambda r: F.when(r["precip_mm"] >= 1, r["precip_mm"])).alias("precipitation_sum"),
        field("wind_max_ms").alias("wind_speed_10m_max"),
    )
    payload = blocks.select("cell_key", F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"}).alias("payload"))
    return _days(feed.daily_to_rows(payload, F.col("payload")).drop("payload"))


@query("scan_hits", "SELECT event_id, ts, visitor, kind, page, country FROM hits ORDER BY ts DESC, event_id DESC LIMIT 50000")
def scan_hits(db):
    return hits.newest(db.hits.select("event_id", "ts", "visitor", "kind", "page", "country"), 50_000)


_DELTAS = ", ".join(f"R6(floor(q[{i + 1}] * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE) AS {d}" for i, d in enumerate(DELTA_COLUMNS))
_MONTHS = (
    "(SELECT cell_key, CAST(month(date) AS INT) AS doy, quantile_cont(era5 - hres, [0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99]) AS q "
    "FROM pairs GROUP BY 1, 2)"
)


@query(
    "sink_surface",
    f"SELECT 9 AS v, cell_key, doy, {_DELTAS} FROM {_MONTHS}",
)
def sink_surface(db):
    path = db.staging("surface")
    surface.write_surface(_monthly_surface(db), path, 9)
    return _rounded_surface(surface.read_surface(db.spark, path))


@query(
    "scan_surface",
    f"""WITH s AS (SELECT cell_key, doy, {_DELTAS} FROM {_MONTHS})
    SELECT 9 AS v, * FROM s
    UNION ALL
    SELECT 7, cell_key, doy, d01, dlo, d10, R6(dmid - 0.526307::DOUBLE * (dmid - d10)), dmid,
           R6(dmid + 0.526307::DOUBLE * (d90 - dmid)), d90, dhi, d99 FROM s""",
)
def scan_surface(db):
    path = db.staging("surface")
    rows = _monthly_surface(db)
    surface.write_surface(rows.drop("d25", "d75"), path, 7)
    surface.write_surface(rows, path, 9)
    return _rounded_surface(surface.read_surface(db.spark, path))


def _monthly_surface(db):
    levels = F.array(*[F.lit(p) for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)])
    months = db.pairs.groupBy("cell_key", F.month("date").alias("doy")).agg(
        F.percentile(F.col("era5") - F.col("hres"), levels).alias("q")
    )
    deltas = [half_up(F.col("q")[i], 2).alias(d) for i, d in enumerate(DELTA_COLUMNS)]
    return months.select("cell_key", F.lit("tmax").alias("var"), "doy", F.lit(0.0).alias("hres"), *deltas)


def _rounded_surface(df):
    return df.select(F.col("v").cast("int").alias("v"), "cell_key", "doy", *[r6(F.col(d)).alias(d) for d in DELTA_COLUMNS])


@query(
    "diff_inventory",
    """SELECT status, count(DISTINCT cell_key) AS objects FROM (
         SELECT cell_key, CASE tier WHEN 'archive' THEN 'same' WHEN 'recent' THEN 'mismatch' ELSE 'extra' END AS status
         FROM cell_day) GROUP BY 1""",
)
def diff_inventory(db):
    left, right = db.staging("left"), db.staging("right")
    changed = db.cell_day.withColumn("tmax_C", F.col("tmax_C") + 1)
    for tier in ("archive", "recent"):
        tiers.write_tier_objects(db.cell_day, f"{left}/{tier}", tier)
        tiers.write_tier_objects(db.cell_day if tier == "archive" else changed, f"{right}/{tier}", tier)
    tiers.write_tier_objects(db.cell_day, f"{right}/forecast", "forecast")
    found = inventory.diff_inventory(inventory.inventory(db.spark, left), inventory.inventory(db.spark, right))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("objects"))


@query(
    "cache_frame",
    """SELECT fc_version, count(*) AS n, 0 AS stale FROM labelled GROUP BY 1""",
)
def cache_frame(db):
    path = db.staging("frame")
    frames.store_frame(db.roles, path)
    expected = pair_ops.version_on(F.col("date"))
    return frames.staleness_report(frames.load_frame(db.spark, path, "fc_version", expected), "fc_version", expected)


@query(
    "ingest_hit",
    """SELECT event_id, substr(sha256(concat_ws('|', ip, ua, 'salt')), 1, 16) AS visitor,
              regexp_extract(referer_url, '^https?://([^/?#]+)', 1) AS referer FROM hits""",
)
def ingest_hit(db):
    return hits.ingest(db.hits.drop("visitor"), salt="salt").select("event_id", "visitor", "referer")
