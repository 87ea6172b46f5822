"""Streaming jobs on micro-batches: the tier store, late hours, the heal rule and the hit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.rounding import r6
from isotherm.operators import daily, tiers
from isotherm.plans.registry import query
from isotherm.sources import hits
from isotherm.streaming import jobs
from isotherm.streaming.days import DayJob
from isotherm.streaming.store import AppendLog, TierStore

VALUES = ("tmax_C", "tmin_C", "precip_mm", "wind_max_ms")


def feed(db, batches: list[DataFrame], step, name: str, replay: bool = True) -> None:
    """Run ``step(batch, batch_id)`` as one streaming query over the batches in turn, and give it the last batch a second time."""
    source, checkpoint = db.staging(f"{name}-source"), db.staging(f"{name}-checkpoint")
    for number, batch in enumerate(batches):
        # one more folder of input, one more run of the same query
        batch.write.parquet(f"{source}/part={number}")
        stream = db.spark.readStream.schema(batch.schema).parquet(f"{source}/part=*")
        stream.select(batch.columns).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if replay:
        step(batches[-1], len(batches) - 1)


@query(
    "tier_store",
    """WITH a AS (SELECT cell_key, date, tmax_C FROM tier_rows WHERE tier = 'archive'), old AS (SELECT cell_key, date, tmax_C - 1 AS tmax_C FROM a WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31')
       SELECT cell_key, date, 'archive' AS tier, tmax_C FROM a
       UNION ALL SELECT cell_key, date, 'recent', tmax_C FROM (SELECT * FROM old UNION ALL SELECT cell_key, date, tmax_C FROM tier_rows r WHERE tier = 'recent' AND NOT EXISTS (SELECT 1 FROM old o WHERE o.cell_key = r.cell_key AND o.date = r.date)) x
         WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.cell_key = x.cell_key AND a.date = x.date)
       UNION ALL SELECT cell_key, date, 'forecast', tmax_C + CASE WHEN cell_key IN (SELECT cell_key FROM tier_rows WHERE tier = 'forecast' AND date >= DATE '2001-09-01') THEN 5 ELSE 0 END FROM tier_rows f
         WHERE tier = 'forecast' AND (date >= DATE '2001-09-01' OR cell_key NOT IN (SELECT cell_key FROM tier_rows WHERE tier = 'forecast' AND date >= DATE '2001-09-01'))""",
)
def tier_store(db):
    """Recent days that a later archive supersedes are gone, forecasts are replaced whole, a batch that comes again changes nothing."""
    rows = db.tier_rows.select("cell_key", "date", "tier", "tmax_C").withColumn("seq", F.lit(0))
    archive = rows.where("tier = 'archive'")
    # half a year that was recent first, with other values
    between = archive.where("date BETWEEN DATE'2000-06-01' AND DATE'2000-12-31'").withColumns({"tier": F.lit("recent"), "tmax_C": F.col("tmax_C") - 1})
    recent = rows.where("tier = 'recent'").join(between.select("cell_key", "date"), ["cell_key", "date"], "left_anti").select(rows.columns)
    first = archive.where("date < DATE'2000-06-01'").unionByName(between).unionByName(recent).unionByName(rows.where("tier = 'forecast'"))
    forecast = rows.where("tier = 'forecast' AND date >= DATE'2001-09-01'").withColumn("tmax_C", F.col("tmax_C") + 5)
    late_archive = archive.where("date >= DATE'2000-06-01'")
    store = TierStore(db.spark, db.staging("store"), buckets=8)
    feed(db, [first, forecast, late_archive], store.refresh, "tiers")
    return store.read().select("cell_key", "date", "tier", "tmax_C")


HOURS_SQL = """i AS (SELECT cell_key, ts, ts + INTERVAL 3 HOUR AS l, CAST(ts + INTERVAL 3 HOUR AS DATE) AS date, t2m, sqrt(u10 * u10 + v10 * v10) AS wind,
      greatest(coalesce(CASE WHEN hour(ts) = 1 THEN tp ELSE tp - lag(tp) OVER (PARTITION BY cell_key, CAST(ts - INTERVAL 1 HOUR AS DATE) ORDER BY ts) END, 0.0::DOUBLE), 0.0::DOUBLE) AS incr FROM hourly)"""


def local_hours(db) -> DataFrame:
    return daily.hourly_wind(daily.deaccumulate(db.hourly)).select("cell_key", "ts", "t2m", "tp_incr", "wind").withColumn("offset_h", F.lit(3))


@query(
    "late_hours",
    f"""WITH {HOURS_SQL}, last AS (SELECT CAST(max(l) - INTERVAL 2 DAY AS DATE) AS d FROM i),
      d AS (SELECT cell_key, date, (round_even((max(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS tmax_C, (round_even((min(t2m) - 273.15) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS tmin_C,
                   (round_even((sum(incr) * 1000) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS precip_mm, (round_even((max(wind)) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS wind_max_ms
            FROM i GROUP BY 1, 2 HAVING count(*) = 24)
      SELECT cell_key, date, R6(tmax_C) AS tmax_C, R6(tmin_C) AS tmin_C, R6(precip_mm) AS precip_mm, R6(wind_max_ms) AS wind_max_ms, day(date) % 3 = 0 AS was_late FROM d WHERE date < (SELECT d FROM last)""",
)
def late_hours(db):
    """Every third day lacks its noon until the watermark has closed it; the late hour completes the day and the store takes it up."""
    rows = local_hours(db)
    local = F.col("ts") + F.expr("INTERVAL 3 HOURS")
    held_back = (F.day(local) % 3 == 0) & (F.hour(local) == 12)
    # days past the last closed one have no late hour: nothing has closed them
    end = rows.agg(F.to_date(F.max(local) - F.expr("INTERVAL 2 DAYS")).alias("_end"))
    late = rows.where(held_back).join(F.broadcast(end), F.to_date(local) < F.col("_end")).select(rows.columns)
    job, store = DayJob(db.spark, db.staging("days")), TierStore(db.spark, db.staging("day-store"), buckets=8)
    # the second batch repeats some hours of the first
    feed(db, [rows.where(~held_back).where("ts < TIMESTAMP_NTZ'2024-01-16 00:00:00'"), rows.where(~held_back).where("ts >= TIMESTAMP_NTZ'2024-01-15 06:00:00'"), late], job.process, "hours")
    on_time, completed = job.days().select("cell_key", "date", *VALUES), job.late_days().select("cell_key", "date", *VALUES)
    tag = lambda df, flag: df.withColumns({"tier": F.lit("archive"), "seq": F.lit(0), "was_late": F.lit(flag)})
    store.merge_late(tag(on_time, False), 0)
    store.merge_late(tag(completed, True), 1)
    return store.read().select("cell_key", "date", *[r6(F.col(c)).alias(c) for c in VALUES], "was_late")


#: cell c1 misses a day long past, c2 one just behind the frontier, c3 nothing but its tail; c4 has no archive
HOLES_SQL = """days AS (SELECT cell_key, date, tier FROM cell_day WHERE (tier = 'archive' AND cell_key <> 'c4')
          OR (tier = 'recent' AND NOT (cell_key = 'c1' AND date = DATE '2001-02-10') AND NOT (cell_key = 'c2' AND date = DATE '2001-04-22') AND NOT (cell_key <> 'c1' AND cell_key <> 'c2' AND date > DATE '2001-04-20'))),
      ends AS (SELECT cell_key, max(date) AS archive_end FROM days WHERE tier = 'archive' GROUP BY 1),
      seam AS (SELECT d.cell_key, d.date FROM days d JOIN ends e ON e.cell_key = d.cell_key WHERE d.tier = 'recent' AND d.date > archive_end UNION SELECT cell_key, archive_end FROM ends),
      miss AS (SELECT cell_key, CAST(min(date) + INTERVAL 1 DAY AS DATE) AS first_missing FROM seam s WHERE NOT EXISTS (SELECT 1 FROM seam n WHERE n.cell_key = s.cell_key AND n.date = s.date + 1) GROUP BY 1),
      upd AS (SELECT cell_key, max(date) + INTERVAL 6 HOUR AS updated_at FROM days WHERE tier = 'recent' GROUP BY 1),
      asks AS (SELECT m.cell_key, first_missing, first_missing + INTERVAL 9 DAY AS heal, greatest(updated_at + INTERVAL 24 HOUR, CAST(first_missing AS TIMESTAMP)) AS extend FROM miss m JOIN upd u ON u.cell_key = m.cell_key)"""


def seam_days(db) -> DataFrame:
    """Archive and recent days with a few holes."""
    recent = (F.col("tier") == "recent") & ~((F.col("cell_key") == "c1") & (F.col("date") == "2001-02-10")) & ~((F.col("cell_key") == "c2") & (F.col("date") == "2001-04-22"))
    recent = recent & (F.col("cell_key").isin("c1", "c2") | (F.col("date") <= "2001-04-20"))
    return db.cell_day.where(((F.col("tier") == "archive") & (F.col("cell_key") != "c4")) | recent).select("cell_key", "date", "tier")


def seam_updates(days: DataFrame) -> DataFrame:
    newest = days.where("tier = 'recent'").groupBy("cell_key").agg(F.max("date").alias("_newest"))
    return newest.select("cell_key", (F.col("_newest").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("updated_at"))


@query(
    "heal_rule",
    f"""WITH {HOLES_SQL} SELECT cell_key, first_missing, first_missing > DATE '2001-04-21' AS tail_only, least(heal, extend) AS due, CASE WHEN heal <= extend THEN 'heal' ELSE 'extend' END AS reason,
        least(heal, extend) <= TIMESTAMP '2001-04-30 18:00:00' AS refresh FROM asks""",
)
def heal_rule(db):
    days = seam_days(db)
    rows = tiers.heal_rule(days, seam_updates(days), F.lit("2001-04-30 18:00:00").cast("timestamp"))
    return rows.withColumn("due", F.col("due").cast("timestamp_ntz"))


@query(
    "freshness_live",
    f"""WITH {HOLES_SQL}, e AS (SELECT cell_key, first_missing, heal AS due, 'heal' AS reason FROM asks UNION ALL SELECT cell_key, first_missing, extend, 'extend' FROM asks WHERE extend < heal)
        SELECT * FROM e WHERE due <= TIMESTAMP '2001-05-10 00:00:00'""",
)
def freshness_live(db):
    """The same holes as a stream: timers fire as the watermark passes them, up to the hour of the last event."""
    days = seam_days(db)
    updates = days.join(seam_updates(days), "cell_key").withColumn("updated_ms", F.unix_millis("updated_at"))
    # events come in the order of their days, some years in a batch; a last one moves the clock
    ts = F.least(F.col("updated_at"), F.col("date").cast("timestamp"))
    events = updates.select("cell_key", "tier", "date", "updated_ms", ts.alias("ts"))
    clock = db.spark.range(1).selectExpr("'clock' AS cell_key", "'archive' AS tier", "DATE'2001-05-10' AS date", "0L AS updated_ms", "TIMESTAMP'2001-05-10 00:00:00' AS ts")
    source, out, checkpoint = db.staging("seam"), db.staging("decisions"), db.staging("checkpoint")
    for number, part in enumerate((events, clock)):
        part.write.parquet(f"{source}/part={number}")
        stream = db.spark.readStream.schema(events.schema).parquet(f"{source}/part=*").select(events.columns).withWatermark("ts", "0 seconds")
        jobs.run_to_end(jobs.recent_decisions(stream), out, checkpoint)
    found = db.spark.read.schema("cell_key STRING, first_missing DATE, reason STRING, due_ms LONG").parquet(out)
    return found.select("cell_key", "first_missing", F.timestamp_millis("due_ms").cast("timestamp_ntz").alias("due"), "reason")


@query(
    "append_hits",
    """SELECT event_id, CASE WHEN event_id % 9 = 4 OR event_id % 13 = 5 THEN 'owner' ELSE substr(sha256(concat_ws('|', ip, ua, 'salt')), 1, 16) END AS visitor,
              regexp_extract(referer_url, '^https?://([^/?#]+)', 1) AS referer, ua FROM hits""",
)
def append_hits(db):
    """Raw requests in three micro-batches, the last one delivered twice: each hit is there once, and the owner's go under one name."""
    raw = db.hits.drop("visitor").withColumns(
        {
            # the owner works on a local page, or shows the key
            "origin_url": F.when(F.col("event_id") % 9 == 4, F.lit("http://localhost:5173/x")),
            "owner": F.when(F.col("event_id") % 13 == 5, F.lit("key")).when(F.col("event_id") % 13 == 6, F.lit("wrong key")),
        }
    )
    log = AppendLog(db.spark, db.staging("hits"))
    parts = [raw.where(F.col("event_id") % 3 == k) for k in range(3)]
    feed(db, parts, lambda batch, number: log.append(hits.ingest(batch, salt="salt", owner_key="key"), number), "raw")
    return log.read().select("event_id", "visitor", "referer", "ua")
