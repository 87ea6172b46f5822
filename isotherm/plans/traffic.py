"""Traffic analytics, the cell list and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions import traffic as rules
from isotherm.functions.rounding import r6
from isotherm.operators import cells, daily, spatial, tiers, traffic
from isotherm.plans.columns import BARE_SINCE, BOT_SQL, SIGNATURE_SQL
from isotherm.plans.registry import query
from isotherm.streaming import jobs
from isotherm.streaming.store import TierStore

CONTENT = "len(page) - len(replace(page, '/', '')) >= 3"
SESSION_SQL = f"""(SELECT *, sum(new) OVER (PARTITION BY visitor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
   SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY visitor ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY visitor ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM hits WHERE {CONTENT}))"""


@query("sessionize", f'SELECT visitor, CAST(session AS BIGINT) AS session, min(ts) AS "start", max(ts) AS "end", count(*) AS hits, count(DISTINCT page) AS pages FROM {SESSION_SQL} GROUP BY 1, 2')
def sessionize(db):
    return traffic.sessions(db.hits.where(rules.content_page(F.col("page"))))


HUMANS = f"(SELECT DISTINCT visitor FROM (SELECT visitor, session, count(DISTINCT page) AS p FROM {SESSION_SQL} GROUP BY 1, 2) WHERE p >= 3)"


@query("flag_humans", f"SELECT event_id, NOT {BOT_SQL} AND (NOT {SIGNATURE_SQL} OR visitor IN {HUMANS}) AS human FROM hits")
def flag_humans(db):
    return traffic.flag_humans(db.hits, BARE_SINCE).select("event_id", "human")


def _over_time(trunc, step, measure):
    return f"""WITH t AS (SELECT country FROM hits GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 8),
      c AS (SELECT {trunc} AS bucket, CASE WHEN country IN (SELECT country FROM t) THEN country ELSE 'Other' END AS country, {measure} AS n FROM hits GROUP BY 1, 2),
      e AS (SELECT unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), INTERVAL {step})) AS bucket)
      SELECT e.bucket, c.country, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.bucket = c.bucket"""


@query("hits_over_time", _over_time("time_bucket(INTERVAL 10 MINUTE, ts)", "10 MINUTE", "count(*)"))
def hits_over_time(db):
    return traffic.hits_over_time(db.hits, "10m")


@query("people_over_time", _over_time("date_trunc('hour', ts)", "1 HOUR", "count(DISTINCT visitor)"))
def people_over_time(db):
    return traffic.hits_over_time(db.hits, "hour", people=True)


@query("hit_summary", "SELECT count(*) AS shown, count(DISTINCT visitor) AS people, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM hits")
def hit_summary(db):
    return traffic.hit_summary(db.hits)


@query("traffic_tops", "SELECT country, count(*) AS n, R6(100.0 * count(*) / (SELECT count(*) FROM hits)) AS pct FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def traffic_tops(db):
    return traffic.top_shares(db.hits, "country", 10).withColumn("pct", r6(F.col("pct")))


@query("top_k_share", "SELECT page, count(*) AS n, R6(100.0 * count(*) / (SELECT count(*) FROM hits)) AS pct FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_k_share(db):
    return traffic.top_shares(db.hits, "page", 25).withColumn("pct", r6(F.col("pct")))


@query(
    "link_mix",
    """WITH c AS (SELECT page, country, count(*) AS n FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, country) AS rn FROM c)
      SELECT page, CAST(sum(n) AS BIGINT) AS views, string_agg(concat(country, ' ', n), ', ' ORDER BY rn) FILTER (rn <= 5) AS mix FROM r GROUP BY 1""",
)
def link_mix(db):
    return traffic.country_mix(db.hits, "page", 5)


@query("sort_table", "SELECT event_id, query, ts, row_number() OVER (ORDER BY coalesce(query, '') DESC, event_id) AS position FROM hits")
def sort_table(db):
    return traffic.sort_table(db.hits.select("event_id", "query", "ts"), "query", True, ["event_id"])


@query("search_gaps", "SELECT query, count(*) AS searches, count_if(matched IS NULL) AS unmatched, count(*) FILTER (dist_km > 100) AS far, R6(max(dist_km)) AS worst_km FROM hits WHERE kind = 'search' GROUP BY 1")
def search_gaps(db):
    return traffic.search_gaps(db.hits, 100.0).withColumn("worst_km", r6(F.col("worst_km")))


# ---- the cell list -------------------------------------------------------------------------

PEOPLE = "(SELECT floor(lat * 10 + 0.5) / 10 + 0.0 AS lat, floor(lon * 10 + 0.5) / 10 + 0.0 AS lon, round(sum(CASE WHEN pop < 0 THEN 0 ELSE pop END), 2) AS population FROM pixels GROUP BY 1, 2)"


def people(db):
    return spatial.zonal_population(db.pixels).withColumn("population", F.round("population", 2))


@query("top_cells", f"SELECT R6(lat) AS lat, R6(lon) AS lon, population, row_number() OVER (ORDER BY population DESC, lat, lon) - 1 AS cell_id FROM {PEOPLE} WHERE population > 0 ORDER BY population DESC, lat, lon LIMIT 500")
def top_cells(db):
    return cells.top_cells(people(db), 500).select(r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "population", "cell_id")


@query("sample_cells", "SELECT cell_id, name FROM cells ORDER BY md5(concat('7:', cell_id)), cell_id LIMIT 100")
def sample_cells(db):
    return cells.hashed_sample(db.cells, 100, 7, key="cell_id").select("cell_id", "name")


@query(
    "merge_selections",
    """WITH b AS (SELECT lat, lon, population FROM cells WHERE population >= 500000), r AS (SELECT lat, lon, population + 1 AS population FROM cells WHERE lat BETWEEN 20 AND 60),
      m AS (SELECT * FROM r UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.lat = b.lat AND r.lon = b.lon))
      SELECT lat, lon, population, row_number() OVER (ORDER BY population DESC, lat, lon) - 1 AS cell_id FROM m""",
)
def merge_selections(db):
    base = db.cells.where("population >= 500000").select("lat", "lon", "population", F.lit(-1).alias("cell_id"))
    region = db.cells.where(F.col("lat").between(20, 60)).select("lat", "lon", (F.col("population") + 1).alias("population"), F.lit(-1).alias("cell_id"))
    return cells.merge_selections(base, region)


def _wind(clat, clon, lat, lon):
    east = f"sin(radians({lon} - {clon})) * cos(radians({lat}))"
    north = f"cos(radians({clat})) * sin(radians({lat})) - sin(radians({clat})) * cos(radians({lat})) * cos(radians({lon} - {clon}))"
    b = f"(degrees(atan2({east}, {north})) + 360)"
    return f"['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(round_even((CASE WHEN {b} >= 360 THEN {b} - 360 ELSE {b} END) / 45, 0) AS INT) % 8 + 1]"


@query(
    "unique_names",
    f"""WITH g AS (SELECT label, count(*) AS m, avg(lat) AS clat, avg(lon) AS clon FROM cells GROUP BY 1),
      r AS (SELECT c.*, m, row_number() OVER (PARTITION BY c.label ORDER BY population DESC, cell_id) AS pr, concat(c.label, ' (', {_wind('clat', 'clon', 'lat', 'lon')}, ')') AS cand FROM cells c JOIN g ON c.label = g.label),
      w AS (SELECT cand, cell_id, row_number() OVER (PARTITION BY cand ORDER BY population DESC, cell_id) AS wr FROM r WHERE pr > 1)
      SELECT r.cell_id, CASE WHEN pr = 1 THEN label WHEN wr = 1 THEN r.cand ELSE concat(label, ' (', printf('%.1f', lat + 0.0), ', ', printf('%.1f', lon + 0.0), ')') END AS unique_name FROM r LEFT JOIN w ON r.cell_id = w.cell_id""",
)
def unique_names(db):
    return cells.unique_names(db.cells, "label").select("cell_id", "unique_name")


LABEL_KM = 3000.0
LABELLED_CELLS = "(SELECT cell_id, lat, lon, concat('Place ', cell_id % 40, ', Shire ', cell_id % 3, ', Land ', country, CASE WHEN cell_id % 4 = 0 THEN ' (NW)' ELSE '' END) AS name, country FROM cells)"


@query(
    "label_repairs",
    f"""WITH c AS (SELECT *, cell_id % 40 AS k FROM {LABELLED_CELLS}),
      m AS (SELECT c.cell_id, g.cc, g.place_id, {"2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(sin(radians(g.lat - c.lat) / 2) ** 2 + cos(radians(c.lat)) * cos(radians(g.lat)) * sin(radians(g.lon - c.lon) / 2) ** 2)))"} AS km FROM c JOIN gazetteer g ON g.name = concat('Place ', c.k)),
      a AS (SELECT cell_id, list(DISTINCT cc) AS ccs, arg_min(cc, km) AS near FROM m WHERE km <= {LABEL_KM} GROUP BY 1)
      SELECT c.cell_id, name, concat('Shire ', c.cell_id % 3, ', Land ', country, CASE WHEN c.cell_id % 4 = 0 THEN ' (NW)' ELSE '' END) AS dropped,
             concat('Place ', k, ', Shire ', c.cell_id % 3, ', Land ', near, CASE WHEN c.cell_id % 4 = 0 THEN ' (NW)' ELSE '' END) AS retailed
      FROM c JOIN a ON a.cell_id = c.cell_id WHERE NOT list_contains(ccs, country)""",
)
def label_repairs(db):
    name = F.concat(
        F.lit("Place "), F.col("cell_id") % 40, F.lit(", Shire "), F.col("cell_id") % 3, F.lit(", Land "), F.col("country"), F.when(F.col("cell_id") % 4 == 0, " (NW)").otherwise("")
    )
    countries = db.read("nation").select(F.col("n_nationkey").alias("cc"), F.concat(F.lit("Land "), F.col("n_nationkey")).alias("country"))
    return cells.repair_labels(db.cells.withColumn("name", name), db.gazetteer, countries, LABEL_KM)


# ---- streaming -----------------------------------------------------------------------------


def _stream(db, df, name):
    """A stream over a stored copy of a view."""
    path = db.staging(name)
    df.write.parquet(path)
    return db.spark.readStream.schema(df.schema).parquet(path)


def _finished(db, stream, name):
    out, checkpoint = db.staging(f"{name}-out"), db.staging(f"{name}-checkpoint")
    jobs.run_to_end(stream, out, checkpoint)
    return db.spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_daily",
    """WITH i AS (SELECT cell_key, ts + INTERVAL 3 HOUR AS l, t2m, sqrt(u10 * u10 + v10 * v10) AS wind, greatest(coalesce(CASE WHEN hour(ts) = 1 THEN tp ELSE tp - lag(tp) OVER (PARTITION BY cell_key, CAST(ts - INTERVAL 1 HOUR AS DATE) ORDER BY ts) END, 0.0::DOUBLE), 0.0::DOUBLE) AS rain FROM hourly), d AS (SELECT cell_key, CAST(l AS DATE) AS date, (round_even((max(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS tmax_C, (round_even((sum(rain) * 1000) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS precip_mm, (round_even((max(wind)) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS wind_max_ms FROM i GROUP BY 1, 2 HAVING count(*) = 24)
      SELECT cell_key, date, R6(tmax_C) AS tmax_C, R6(precip_mm) AS precip_mm, R6(wind_max_ms) AS wind_max_ms FROM d WHERE date < (SELECT CAST(max(l) - INTERVAL 2 DAY AS DATE) FROM i)""",
)
def stream_daily(db):
    rows = daily.hourly_wind(daily.deaccumulate(db.hourly)).withColumn("offset_h", F.lit(3))
    done = _finished(db, jobs.complete_days(_stream(db, rows, "hours")), "days")
    return done.select("cell_key", "date", r6(F.col("tmax_C")).alias("tmax_C"), r6(F.col("precip_mm")).alias("precip_mm"), r6(F.col("wind_max_ms")).alias("wind_max_ms"))


@query(
    "stream_hits",
    """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, country, count(*) AS hits, count(DISTINCT visitor) AS people FROM hits GROUP BY 1, 2
       HAVING time_bucket(INTERVAL 10 MINUTE, min(ts)) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM hits)""",
)
def stream_hits(db):
    hits = _stream(db, db.hits.select("ts", "visitor", "country"), "hits")
    people = F.hll_sketch_estimate("sketch").alias("people")
    return _finished(db, jobs.hit_buckets(hits), "buckets").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "country", "hits", people)


@query(
    "stream_people",
    """WITH f AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM hits), done AS (SELECT * FROM f WHERE b + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM hits)),
       g AS (SELECT '10 minutes' AS grain, b AS start, country, visitor FROM done UNION ALL SELECT 'hour', date_trunc('hour', b), country, visitor FROM done UNION ALL SELECT 'day', date_trunc('day', b), country, visitor FROM done)
       SELECT grain, start, country, count(*) AS hits, count(DISTINCT visitor) AS people, true AS within_error FROM g GROUP BY 1, 2, 3""",
)
def stream_people(db):
    """Three grains from the stream's sketches beside the exact batch count; four standard errors bound the gap."""
    rows = db.hits.select("ts", "visitor", "country")
    buckets = _finished(db, jobs.hit_buckets(_stream(db, rows, "people")), "people")
    sketched = jobs.people_rollup(buckets).withColumnRenamed("people", "estimate")
    until = rows.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 HOUR")).alias("_until"))
    bucketed = rows.withColumn("_w", F.window(F.col("ts").cast("timestamp"), "10 minutes"))
    closed = bucketed.join(F.broadcast(until), F.col("_w.end") <= F.col("_until")).select(*rows.columns)
    exact = jobs.people_exact(closed).select("grain", "start", "country", F.col("hits").alias("exact_hits"), "people")
    within = (F.abs(F.col("estimate") - F.col("people")) <= 4 * jobs.SKETCH_ERROR * F.col("people")) & (F.col("hits") == F.col("exact_hits"))
    both = sketched.join(exact, ["grain", "start", "country"], "full_outer")
    return both.select("grain", F.col("start").cast("timestamp_ntz").alias("start"), "country", "hits", "people", F.coalesce(within, F.lit(False)).alias("within_error"))


@query(
    "stream_sessions",
    f"""SELECT visitor, "start", "end", hits, pages FROM (SELECT visitor, session, min(ts) AS "start", max(ts) AS "end", count(*) AS hits, CAST(count(DISTINCT page) AS INT) AS pages FROM {SESSION_SQL} GROUP BY 1, 2)
        WHERE "end" + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM hits WHERE {CONTENT})""",
)
def stream_sessions(db):
    content = db.hits.where(rules.content_page(F.col("page"))).select("ts", "visitor", "page")
    done = _finished(db, jobs.visitor_sessions(_stream(db, content, "content")), "sessions")
    pages = _finished(db, jobs.slot_pages(_stream(db, content, "paged")), "pages")
    counted = jobs.count_pages(done, pages)
    return counted.select("visitor", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "hits", "pages")


@query("dedupe_events", "SELECT DISTINCT event_id FROM hits")
def dedupe_events(db):
    rows = db.hits.select("event_id", "ts")
    twice = _stream(db, rows.unionByName(rows), "twice")
    return _finished(db, jobs.unique_events(twice, ["event_id"]), "once").select("event_id")


def _tier_batches(db, method):
    """Two micro-batches into a tier store: first archive and forecast, then recent and a new forecast."""
    store = TierStore(db.spark, db.staging("store"))
    rows = db.tier_rows.withColumn("seq", F.lit(0))
    later = rows.where("tier <> 'archive'").withColumn("tmax_C", F.col("tmax_C") + 2)
    for number, batch in enumerate((rows.where("tier <> 'recent'"), later.where("tier = 'recent' OR date >= DATE'2001-06-01'"))):
        stream = _stream(db, batch, f"batch{number}")
        job = stream.writeStream.foreachBatch(lambda df, _, n=number: getattr(store, method)(df, n)).option("checkpointLocation", db.staging("ck")).trigger(availableNow=True).start()
        job.awaitTermination()
    return store.read()


@query(
    "stream_tier_upsert",
    """SELECT cell_key, date, tier, tmax_C FROM tier_rows WHERE tier = 'archive' UNION ALL SELECT cell_key, date, tier, tmax_C + 2 FROM tier_rows r WHERE (tier = 'recent' AND NOT EXISTS (SELECT 1 FROM tier_rows a WHERE a.tier = 'archive' AND a.cell_key = r.cell_key AND a.date = r.date)) OR (tier = 'forecast' AND date >= DATE '2001-06-01')""",
)
def stream_tier_upsert(db):
    return _tier_batches(db, "refresh").select("cell_key", "date", "tier", "tmax_C")


@query(
    "late_data",
    """SELECT cell_key, date, tier, CASE WHEN tier = 'recent' OR (tier = 'forecast' AND date >= DATE '2001-06-01') THEN tmax_C + 2 ELSE tmax_C END AS tmax_C FROM tier_rows""",
)
def late_data(db):
    return _tier_batches(db, "merge_late").select("cell_key", "date", "tier", "tmax_C")


@query(
    "resume_ledger",
    """SELECT DISTINCT cell_key, CAST(year(date) AS INT) AS first_year, CAST(year(date) AS INT) AS last_year FROM cell_day WHERE NOT (year(date) <= 1998)""",
)
def resume_ledger(db):
    wanted = db.cell_day.select("cell_key", F.year("date").alias("first_year"), F.year("date").alias("last_year")).distinct()
    ledger = wanted.where("first_year <= 1998").withColumn("signature", F.lit("run-a")).unionByName(wanted.withColumn("signature", F.lit("run-b")))
    path = db.staging("ledger")
    ledger.write.parquet(path)
    return jobs.pending_work(wanted, db.spark.read.parquet(path), "run-a")


@query("degenerate_cells", "SELECT cell_key, metric, count(archive) AS days FROM (SELECT cell_key, metric, CASE WHEN metric = 'precip' AND cell_key = 'c1' THEN 0.0 WHEN metric = 'wind' AND cell_key = 'c2' THEN NULL ELSE archive END AS archive FROM pairs_long) GROUP BY 1, 2 HAVING count(archive) = 0 OR stddev_samp(archive) < 1e-6")
def degenerate_cells(db):
    broken = F.when((F.col("metric") == "precip") & (F.col("cell_key") == "c1"), 0.0).when((F.col("metric") == "wind") & (F.col("cell_key") == "c2"), None).otherwise(F.col("archive"))
    return tiers.degenerate(db.pairs_long.withColumn("archive", broken), ["cell_key", "metric"], "archive")
