"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions import bands as band_fn
from isotherm.functions import calendar, derive, geo, traffic, units
from isotherm.functions.rounding import half_up, r6, snap
from isotherm.operators import bands, daily, pairs, tiers
from isotherm.plans.registry import query
from isotherm.schemas import BAND_COLUMNS, DELTA_COLUMNS

TARGET = "2001-06-15"


def target():
    return F.lit(TARGET).cast("date")


@query(
    "snap_grid",
    """SELECT place_id, R6(floor(lat * 10 + 0.5) / 10) AS lat_up, R6(round_even(lat * 10, 0) / 10) AS lat_even,
              R6(floor(lon * 10 + 0.5) / 10) AS lon_up FROM gazetteer""",
)
def snap_grid(db):
    return db.gazetteer.select(
        "place_id",
        r6(snap(F.col("lat"))).alias("lat_up"),
        r6(snap(F.col("lat"), "half_even")).alias("lat_even"),
        r6(snap(F.col("lon"))).alias("lon_up"),
    )


@query("cell_key", "SELECT cell_id, concat(printf('%.1f', lat + 0.0), '_', printf('%.1f', lon + 0.0)) AS cell_key FROM cells")
def cell_key(db):
    return db.cells.select("cell_id", geo.cell_key(F.col("lat"), F.col("lon")).alias("cell_key"))


TILE_SQL = """SELECT cell_id, concat(r, '_', c) AS tile_id, 90.0::DOUBLE - r * 5 AS tile_lat, c * 10.0::DOUBLE AS tile_lon FROM (
  SELECT cell_id, CAST(floor(round_even((90 - lat) / 0.1::DOUBLE, 0) / 50) AS BIGINT) AS r,
         CAST(floor(round_even((CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / 0.1::DOUBLE, 0) / 100) AS BIGINT) AS c FROM cells)"""


@query("tile_id", TILE_SQL)
def tile_id(db):
    tile = geo.tile(F.col("lat"), F.col("lon"))
    return db.cells.select("cell_id", *[c.alias(n) for n, c in tile.items()])


@query("trace_clamp", "SELECT cell_key, date, CASE WHEN precip_mm < 1 THEN 0 ELSE precip_mm END AS precip_mm FROM cell_day")
def trace_clamp(db):
    return db.cell_day.select("cell_key", "date", band_fn.trace_clamp(F.col("precip_mm")).alias("precip_mm"))


@query(
    "convert_units",
    """SELECT cell_key, date, R6(tmax_C * 9 / 5 + 32) AS tmax_f, R6((tmax_C - tmin_C) * 9 / 5) AS range_f,
              R6(precip_mm / 25.4::DOUBLE) AS rain_in, R6(wind_max_ms * 3.6::DOUBLE) AS wind_kmh,
              R6(wind_max_ms * 2.2369362921::DOUBLE) AS wind_mph FROM cell_day""",
)
def convert_units(db):
    c = F.col
    return db.cell_day.select(
        "cell_key",
        "date",
        r6(units.convert(c("tmax_C"), "tmax", "imperial")).alias("tmax_f"),
        r6(units.convert_delta(c("tmax_C") - c("tmin_C"), "tmax", "imperial")).alias("range_f"),
        r6(units.convert(c("precip_mm"), "precip", "imperial")).alias("rain_in"),
        r6(units.convert(c("wind_max_ms"), "wind", "metric")).alias("wind_kmh"),
        r6(units.convert(c("wind_max_ms"), "wind", "imperial")).alias("wind_mph"),
    )


@query(
    "derive_daily_units",
    """SELECT cell_key, CAST(ts AS DATE) AS date, R6((round_even((max(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE)) AS tmax_C, R6((round_even((min(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE)) AS tmin_C,
              R6((round_even((max(sqrt(u10 * u10 + v10 * v10))) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE)) AS wind_max_ms, count(*) AS hours
       FROM hourly GROUP BY 1, 2""",
)
def derive_daily_units(db):
    rows = daily.with_local_day(daily.hourly_wind(daily.deaccumulate(db.hourly)), F.lit(0))
    return daily.daily_metrics(rows, complete_only=False).select(
        "cell_key", "date", r6(F.col("tmax_C")).alias("tmax_C"), r6(F.col("tmin_C")).alias("tmin_C"),
        r6(F.col("wind_max_ms")).alias("wind_max_ms"), "hours",
    )


@query("solar_offset", "SELECT cell_id, CAST(round_even(lon / 15, 0) AS INT) AS offset_h FROM cells")
def solar_offset(db):
    return db.cells.select("cell_id", geo.solar_offset(F.col("lon")).alias("offset_h"))


@query("local_day", "SELECT cell_key, ts, CAST(ts + INTERVAL (-6) HOUR AS DATE) AS west, CAST(ts + INTERVAL 3 HOUR AS DATE) AS east FROM hourly")
def local_day(db):
    west = daily.with_local_day(db.hourly, F.lit(-6)).withColumnRenamed("local_date", "west")
    return daily.with_local_day(west, F.lit(3)).select("cell_key", "ts", "west", F.col("local_date").alias("east"))


@query(
    "to_numeric",
    """SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN concat(' ', value) ELSE 'n/a' END) AS DOUBLE) AS value
       FROM events""",
)
def to_numeric(db):
    text = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "value")).otherwise("n/a")
    return db.read("events").select("event_id", derive.to_number(text).alias("value"))


@query("year_range", "SELECT cell_key, date, tmax_C FROM cell_day WHERE year(date) BETWEEN 1996 AND 1999")
def year_range(db):
    return db.cell_day.where(F.year("date").between(1996, 1999)).select("cell_key", "date", "tmax_C")


@query("on_date", f"SELECT cell_key, date, tmax_C, tier FROM cell_day WHERE date = DATE '{TARGET}'")
def on_date(db):
    return db.cell_day.where(F.col("date") == target()).select("cell_key", "date", "tmax_C", "tier")


SEASON_SQL = "date BETWEEN make_date(year(date), 6, 15) - 3 AND make_date(year(date), 6, 15) + 3"


def in_window(db):
    return db.cell_day.where(calendar.in_season(F.col("date"), 6, 15, 3))


@query("seasonal_window", f"SELECT cell_key, date, tmax_C, tier FROM cell_day WHERE {SEASON_SQL}")
def seasonal_window(db):
    return in_window(db).select("cell_key", "date", "tmax_C", "tier")


@query("comparable_pool", f"SELECT cell_key, date, tmax_C FROM cell_day WHERE NOT (tier = 'forecast' AND date > DATE '{TARGET}')")
def comparable_pool(db):
    return db.cell_day.where(tiers.comparable(F.col("tier"), F.col("date"), target())).select("cell_key", "date", "tmax_C")


@query(
    "observed_pool",
    """SELECT cell_key, date, 'tmax' AS metric, tmax_C AS value FROM cell_day WHERE tier <> 'forecast'
       UNION ALL SELECT cell_key, date, 'precip', precip_mm FROM cell_day WHERE tier NOT IN ('forecast', 'recent')""",
)
def observed_pool(db):
    def pool(metric, column):
        rows = db.cell_day.where(tiers.observed(F.col("tier"), metric))
        return rows.select("cell_key", "date", F.lit(metric).alias("metric"), F.col(column).alias("value"))

    return pool("tmax", "tmax_C").unionByName(pool("precip", "precip_mm"))


@query("archive_only", "SELECT cell_key, date, tmax_C FROM cell_day WHERE tier = 'archive'")
def archive_only(db):
    return db.cell_day.where(tiers.archive_only(F.col("tier"))).select("cell_key", "date", "tmax_C")


@query(
    "overlap_slice",
    """SELECT cell_key, date, tmax_C FROM cell_day WHERE tier = 'archive' AND date BETWEEN DATE '1998-03-01' AND DATE '2000-10-01' - 10
       AND cell_key IN (SELECT cell_key FROM static WHERE elevation < 2000)""",
)
def overlap_slice(db):
    archive = db.cell_day.where("tier = 'archive'")
    wanted = db.static.where("elevation < 2000")
    today = F.lit("2000-10-01").cast("date")
    return tiers.overlap_slice(archive, wanted, "1998-03-01", today).select("cell_key", "date", "tmax_C")


@query("region_filter", "SELECT cell_id, lat, lon, population FROM cells WHERE lat BETWEEN 20 AND 50 AND lon BETWEEN -30 AND 60 AND population >= 200000")
def region_filter(db):
    inside = F.col("lat").between(20, 50) & F.col("lon").between(-30, 60) & (F.col("population") >= 200000)
    return db.cells.where(inside).select("cell_id", "lat", "lon", "population")


@query(
    "text_filter",
    """SELECT event_id, page, ua FROM hits WHERE (contains(lower(page), 'tmax') OR contains(lower(page), 'wind'))
       AND NOT contains(lower(ua), 'bot') AND NOT contains(lower(ua), 'python')""",
)
def text_filter(db):
    keep = traffic.text_match(F.col("page"), "tmax, wind") & traffic.text_match(F.col("ua"), "~bot, ~python")
    return db.hits.where(keep).select("event_id", "page", "ua")


@query("since_range", "SELECT event_id, ts FROM hits WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR")
def since_range(db):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return db.hits.where(F.col("ts") >= now - F.expr("INTERVAL 6 HOURS")).select("event_id", "ts")


BARE_SINCE = "2024-01-15 00:00:00"
BOT_SQL = """regexp_matches(lower(ua), 'bot|spider|crawl|python|curl|wget|go-http|scan|okhttp|java/|headless|node-fetch|axios|libwww')"""
SIGNATURE_SQL = """(regexp_matches(lower(asn_org), 'amazon|microsoft|azure|hetzner|ovh|oracle')
   OR (regexp_matches(lower(asn_org), 'cloudflare|akamai|fastly|vpn') AND NOT regexp_matches(ua, '(?i)mozilla/.*(safari|chrome|crios|firefox|fxios|edg|opr|samsungbrowser|version/)'))
   OR (regexp_matches(page, '^/-?\\d+(\\.\\d+)?,-?\\d+(\\.\\d+)?$') AND ts >= TIMESTAMP '2024-01-15 00:00:00'))"""


@query("bot_rules", f"SELECT event_id, {BOT_SQL} AS automated, {SIGNATURE_SQL} AS suspicious FROM hits")
def bot_rules(db):
    return db.hits.select(
        "event_id",
        traffic.automation(F.col("ua")).alias("automated"),
        traffic.bot_signature(F.col("asn_org"), F.col("ua"), F.col("page"), F.col("ts"), BARE_SINCE).alias("suspicious"),
    )


@query(
    "page_parse",
    """SELECT event_id, nullif(regexp_extract(page, '/(tmax|tmin|precip|wind)$', 1), '') AS metric,
              CAST(regexp_extract(page, '^/([0-9.]+),', 1) AS DOUBLE) AS lat, CAST(regexp_extract(page, ',([0-9.]+)', 1) AS DOUBLE) AS lon,
              len(page) - len(replace(page, '/', '')) >= 3 AS content,
              len(page) - len(replace(page, '/', '')) >= 3 AND CAST(regexp_extract(page, '^/([0-9.]+),', 1) AS DOUBLE) <= 90 AS shareable
       FROM hits""",
)
def page_parse(db):
    page = F.col("page")
    lat, lon = traffic.page_coordinates(page)
    return db.hits.select(
        "event_id", traffic.page_metric(page).alias("metric"), lat.alias("lat"), lon.alias("lon"),
        traffic.content_page(page).alias("content"), traffic.share_path(page).alias("shareable"),
    )


@query(
    "season_phase",
    """SELECT cell_key, date, R6(cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE)) AS cos_doy, R6(sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE)) AS sin_doy,
              CASE month(date) % 12 // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END AS season FROM pairs""",
)
def season_phase(db):
    cos, sin = calendar.phase(F.col("date"))
    return db.pairs.select("cell_key", "date", r6(cos).alias("cos_doy"), r6(sin).alias("sin_doy"), calendar.calendar_season(F.col("date")).alias("season"))


@query(
    "geo_bands",
    """SELECT p.cell_key, p.date,
              CASE WHEN abs(lat) <= 23.5 THEN 'Tropical' WHEN abs(lat) <= 35 THEN 'Subtropical' WHEN abs(lat) <= 55 THEN 'Mid-latitude' ELSE 'High-latitude' END AS zone,
              CASE WHEN elevation <= 200 THEN 'Lowland' WHEN elevation <= 1000 THEN 'Upland' WHEN elevation <= 2500 THEN 'Highland' ELSE 'Mountain' END AS elev_band,
              CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere, R6(log10(greatest(population, 1))) AS pop_log,
              CASE (CASE WHEN lat >= 0 THEN month(date) ELSE (month(date) + 5) % 12 + 1 END) % 12 // 3
                WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Autumn' END AS local_season,
              CASE WHEN lat >= 0 THEN month(date) IN (12, 1, 2) ELSE month(date) IN (6, 7, 8) END AS local_winter
       FROM pairs p JOIN static s ON p.cell_key = s.cell_key""",
)
def geo_bands(db):
    joined = db.pairs.join(db.static, "cell_key")
    lat, date = F.col("lat"), F.col("date")
    return joined.select(
        "cell_key", "date", derive.climate_zone(lat).alias("zone"), derive.elevation_band(F.col("elevation")).alias("elev_band"),
        derive.hemisphere(lat).alias("hemisphere"), r6(derive.log_population(F.col("population"))).alias("pop_log"),
        calendar.local_season(date, lat).alias("local_season"), calendar.local_winter(date, lat).alias("local_winter"),
    )


@query("version_asof", "SELECT cell_key, date, fc_version FROM labelled")
def version_asof(db):
    return pairs.with_versions(db.pairs).select("cell_key", "date", "fc_version")


@query("bias_target", "SELECT cell_key, date, R6(era5 - hres) AS bias, R6(hres - era5) AS diff FROM pairs")
def bias_target(db):
    rows = pairs.with_bias(db.pairs)
    return rows.select("cell_key", "date", r6(F.col("bias")).alias("bias"), r6(F.col("hres") - F.col("era5")).alias("diff"))


@query("tail_labels", "SELECT cell_key, date, season, dec, dec1, fdec, R6(1 + 3 * abs(2 * (u - 0.5))) AS weight FROM labelled")
def tail_labels(db):
    rows = pairs.tail_labels(db.pairs)
    return rows.select("cell_key", "date", "season", "dec", "dec1", "fdec", r6(pairs.tail_weight(F.col("u"), 3.0)).alias("weight"))


@query(
    "lapse_correct",
    """SELECT p.cell_key, date, R6(hres - era5 - 0.0065::DOUBLE * (elevation - hres_elevation)) AS corrected
       FROM pairs p JOIN static s ON p.cell_key = s.cell_key""",
)
def lapse_correct(db):
    rows = pairs.attach_static(db.pairs, db.static)
    corrected = derive.lapse_corrected(F.col("hres") - F.col("era5"), F.col("elev_diff_m"))
    return rows.select("cell_key", "date", r6(corrected).alias("corrected"))


def month_deltas(db):
    """Nine residual heads per cell and month, two decimals."""
    levels = F.array(*[F.lit(p) for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)])
    months = db.pairs.groupBy("cell_key", F.month("date").alias("month")).agg(
        F.percentile(F.col("era5") - F.col("hres"), levels).alias("q")
    )
    return months.select("cell_key", "month", *[half_up(F.col("q")[i], 2).alias(d) for i, d in enumerate(DELTA_COLUMNS)])


_ABS = ", ".join(
    f"R6(floor(greatest(0, p.hres + floor(q[{i + 1}] * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE) AS {c}"
    for i, c in enumerate(BAND_COLUMNS)
)


@query(
    "band_abs",
    f"""SELECT p.cell_key, p.date, {_ABS} FROM pairs p JOIN (
          SELECT cell_key, month(date) AS mo, quantile_cont(era5 - hres, [0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99]) AS q FROM pairs GROUP BY 1, 2) m
        ON p.cell_key = m.cell_key AND month(p.date) = m.mo""",
)
def band_abs(db):
    joined = db.pairs.withColumn("month", F.month("date")).join(month_deltas(db), ["cell_key", "month"])
    rows = bands.absolute(joined, F.col("hres"), nonneg=True)
    return rows.select("cell_key", "date", *[r6(F.col(c)).alias(c) for c in BAND_COLUMNS])


@query(
    "record_fraction",
    """SELECT c.cell_key, c.date, R6(floor(greatest(0, least(1, CASE WHEN hi > lo THEN (tmax_C - lo) / (hi - lo) WHEN tmax_C > hi THEN 1 WHEN tmax_C < lo THEN 0 ELSE 0.5 END)) * 10 + 0.5) / 10) AS position
       FROM cell_day c JOIN (SELECT cell_key, max(tmax_C) AS hi, min(tmax_C) AS lo FROM cell_day WHERE tier = 'archive' GROUP BY 1) r ON c.cell_key = r.cell_key""",
)
def record_fraction(db):
    archive = db.cell_day.where("tier = 'archive'")
    rail = archive.groupBy("cell_key").agg(F.max("tmax_C").alias("hi"), F.min("tmax_C").alias("lo"))
    position = derive.record_position(F.col("tmax_C"), F.col("lo"), F.col("hi"))
    return db.cell_day.join(rail, "cell_key").select("cell_key", "date", r6(position).alias("position"))


@query("melt_metrics", "SELECT cell_key, date, metric, R6(archive) AS archive, R6(hres) AS hres FROM pairs_long")
def melt_metrics(db):
    return db.pairs_long.select("cell_key", "date", "metric", r6(F.col("archive")).alias("archive"), r6(F.col("hres")).alias("hres"))


@query("weather_flags", "SELECT cell_key, date, era5_precip >= 1 AS wet, era5_precip < 0.1 AS dry, abs(hres_tmax - era5_tmax) > 3 AS big_miss FROM pairs_wide")
def weather_flags(db):
    rain, miss = F.col("era5_precip"), F.abs(F.col("hres_tmax") - F.col("era5_tmax"))
    return db.pairs_wide.select(
        "cell_key", "date", (rain >= derive.WET_MM).alias("wet"), (rain < derive.DRY_MM).alias("dry"), (miss > derive.BIG_MISS).alias("big_miss")
    )


@query("clip_display", "SELECT cell_key, date, metric, R6(least(greatest(hres - archive, -5), 5)) AS shown FROM pairs_long")
def clip_display(db):
    return db.pairs_long.select("cell_key", "date", "metric", r6(derive.clip(F.col("hres") - F.col("archive"), 5.0)).alias("shown"))


@query(
    "snap_to_mid",
    """SELECT c.cell_key, c.date, c.tier, c.tier IN ('forecast', 'recent') AS banded,
              R6(CASE WHEN c.tier IN ('forecast', 'recent') THEN b.mid ELSE c.wind_max_ms END) AS wind_max_ms
       FROM cell_day c JOIN banded b ON c.cell_key = b.cell_key AND c.date = b.date""",
)
def snap_to_mid(db):
    rows = bands.snap_to_median(db.cell_day, db.banded, "wind_max_ms", "wind")
    return rows.select("cell_key", "date", "tier", "banded", r6(F.col("wind_max_ms")).alias("wind_max_ms"))
