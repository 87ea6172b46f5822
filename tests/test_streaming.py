"""Streaming jobs whose state the query comparison does not reach."""

import datetime as dt

from pyspark.sql import functions as F

from isotherm.session import staging_path
from isotherm.streaming import jobs
from isotherm.streaming.days import DayJob
from isotherm.streaming.store import TierStore


def test_expired_tiers_report_only_what_went_stale(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "forecast", 0), ("b", "forecast", 0), ("b", "forecast", 20), ("c", "recent", 22), ("z", "recent", 23)]
    frame = spark.createDataFrame([(k, t, t0 + dt.timedelta(hours=h)) for k, t, h in rows], "cell_key STRING, tier STRING, ts TIMESTAMP")
    frame = frame.withColumn("updated_ms", F.unix_millis("ts"))
    source, out = staging_path(spark, "updates"), staging_path(spark, "expired")
    for hour in sorted({h for *_, h in rows}):
        frame.where(F.col("ts") == F.lit(t0 + dt.timedelta(hours=hour))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "0 seconds")
    jobs.run_to_end(jobs.expired_tiers(stream, {"forecast": 12, "recent": 24}), out, staging_path(spark, "ck"))
    got = {(r["cell_key"], r["tier"]) for r in spark.read.parquet(out).collect()}
    assert ("a", "forecast") in got and ("c", "recent") not in got and ("z", "recent") not in got


def test_a_repeated_batch_changes_nothing(spark):
    store = TierStore(spark, staging_path(spark, "store"))
    first = spark.createDataFrame([("c", "2024-01-01", "archive", 1.0, 0), ("c", "2024-01-05", "forecast", 5.0, 0), ("c", "2024-01-06", "forecast", 6.0, 0)], "cell_key STRING, date STRING, tier STRING, tmax_C DOUBLE, seq INT")
    second = spark.createDataFrame([("c", "2024-01-06", "forecast", 7.0, 0), ("c", "2024-01-06", "forecast", 8.0, 1)], first.schema)
    store.refresh(first, 0)
    store.refresh(second, 1)
    once = {tuple(r) for r in store.read().select("date", "tier", "tmax_C").collect()}
    store.refresh(second, 1)
    assert {tuple(r) for r in store.read().select("date", "tier", "tmax_C").collect()} == once
    assert once == {("2024-01-01", "archive", 1.0), ("2024-01-06", "forecast", 8.0)}


def test_ledger_of_another_run_is_ignored(spark):
    wanted = spark.createDataFrame([("c", 1950, 1969), ("c", 1970, 1989)], "cell_key STRING, first_year INT, last_year INT")
    ledger = wanted.limit(1).withColumn("signature", F.lit("a")).unionByName(wanted.withColumn("signature", F.lit("b")))
    assert jobs.pending_work(wanted, ledger, "a").count() == 1


TIERS = "cell_key STRING, date DATE, tier STRING, tmax_C DOUBLE, seq INT"


def tier_rows(spark, *rows):
    return spark.createDataFrame([(c, dt.date(2024, 1, d), t, v, 0) for c, d, t, v in rows], TIERS)


def held(store):
    return {(r["cell_key"], r["date"].day, r["tier"], r["tmax_C"]) for r in store.read().collect()}


def test_untouched_parts_keep_their_files(spark):
    store = TierStore(spark, staging_path(spark, "store"), buckets=16)
    cells = [f"c{k}" for k in range(40)]
    store.refresh(tier_rows(spark, *[(c, 1, "archive", 1.0) for c in cells]), 0)
    before = dict(((t, b), w) for t, b, w in store.manifest())
    store.refresh(tier_rows(spark, ("c7", 2, "archive", 2.0)), 1)
    after = dict(((t, b), w) for t, b, w in store.manifest())
    changed = {part for part in after if after[part] != before.get(part)}
    assert len(changed) == 1 and len(before) > 8
    assert held(store) == {(c, 1, "archive", 1.0) for c in cells} | {("c7", 2, "archive", 2.0)}


def test_the_archive_supersedes_recent_days_in_any_order(spark):
    store = TierStore(spark, staging_path(spark, "store"), buckets=2)
    store.refresh(tier_rows(spark, ("a", 1, "archive", 1.0), ("a", 2, "recent", 2.0), ("a", 3, "recent", 3.0), ("b", 2, "recent", 9.0), ("a", 9, "forecast", 9.0)), 0)
    store.refresh(tier_rows(spark, ("a", 2, "archive", 2.5)), 1)
    want = {("a", 1, "archive", 1.0), ("a", 2, "archive", 2.5), ("a", 3, "recent", 3.0), ("b", 2, "recent", 9.0), ("a", 9, "forecast", 9.0)}
    assert held(store) == want
    # a recent day that comes after its archive is not taken up
    store.refresh(tier_rows(spark, ("a", 1, "recent", 7.0), ("a", 4, "recent", 4.0), ("a", 10, "forecast", 1.0)), 2)
    want = want - {("a", 9, "forecast", 9.0)} | {("a", 4, "recent", 4.0), ("a", 10, "forecast", 1.0)}
    assert held(store) == want
    store.refresh(tier_rows(spark, ("a", 4, "recent", 99.0)), 2)
    assert held(store) == want and store.done()[-1] == 2
    # the last row of a part goes
    store.refresh(tier_rows(spark, ("a", 3, "archive", 3.0), ("a", 4, "archive", 4.0), ("b", 2, "archive", 9.0)), 3)
    assert {r[2] for r in held(store)} == {"archive", "forecast"}


def test_old_versions_expire(spark):
    path = staging_path(spark, "store")
    store = TierStore(spark, path, buckets=1, keep=2)
    for n in range(5):
        store.refresh(tier_rows(spark, ("a", 1 + n, "archive", float(n))), n)
    assert held(store) == {("a", 1 + n, "archive", float(n)) for n in range(5)}
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/batch=*/tier=archive/bucket=*"))]
    assert len(folders) == 2


def hours(spark, cell, day, which, bump=0.0):
    t0 = dt.datetime(2024, 1, day)
    return [(cell, t0 + dt.timedelta(hours=h), 0, 280.0 + h + bump, 0.001, 1.0) for h in which]


def test_a_late_hour_completes_its_day(spark):
    job = DayJob(spark, staging_path(spark, "days"), dt.timedelta(days=1))
    frame = lambda rows: spark.createDataFrame(rows, "cell_key STRING, ts TIMESTAMP_NTZ, offset_h INT, t2m DOUBLE, tp_incr DOUBLE, wind DOUBLE")
    job.process(frame(hours(spark, "a", 1, range(24)) + hours(spark, "b", 1, [h for h in range(24) if h != 5]) + hours(spark, "c", 1, range(3))), 0)
    assert job.days().count() == 0
    # an hour comes twice; the first one counts
    second = frame(hours(spark, "a", 1, [7], 50.0) + hours(spark, "a", 3, range(24)) + hours(spark, "b", 2, range(24)))
    job.process(second, 1)
    closed = {(r["cell_key"], r["date"].day): r for r in job.days().collect()}
    assert set(closed) == {("a", 1)} and closed["a", 1]["tmax_C"] == round(303.0 - 273.15, 3)
    job.process(second, 1)
    assert job.days().count() == 1
    assert job.late_days().count() == 0
    job.process(frame(hours(spark, "b", 1, [5]) + hours(spark, "c", 1, [4]) + hours(spark, "a", 5, [1])), 2)
    late = {(r["cell_key"], r["date"].day) for r in job.late_days().collect()}
    assert late == {("b", 1)}
    assert {(r["cell_key"], r["date"].day) for r in job.days().collect()} == {("a", 1), ("b", 2), ("a", 3)}


def test_a_crawler_of_many_pages(spark):
    """10^5 pages of one visitor in one session, some seen in many slots."""
    t0 = dt.datetime(2024, 1, 1)
    ids = spark.range(100_000)
    crawl = ids.select(F.lit("bot").alias("visitor"), F.concat(F.lit("/p"), "id").alias("page"), (F.lit(t0) + F.make_dt_interval(secs=F.col("id") / 10)).alias("ts"))
    again = ids.where("id % 1000 = 0").select(F.lit("bot").alias("visitor"), F.lit("/p0").alias("page"), (F.lit(t0) + F.make_dt_interval(secs=F.col("id") / 10 + 0.5)).alias("ts"))
    others = spark.createDataFrame([("x", "/a", t0), ("x", "/a", t0 + dt.timedelta(minutes=29)), ("x", "/b", t0 + dt.timedelta(minutes=70)), ("y", "/end", t0 + dt.timedelta(days=3))], "visitor STRING, page STRING, ts TIMESTAMP")
    source = staging_path(spark, "crawl")
    crawl.unionByName(again).unionByName(others).write.parquet(source)
    stream = spark.readStream.schema("visitor STRING, page STRING, ts TIMESTAMP").parquet(source)
    sessions, pages = staging_path(spark, "sessions"), staging_path(spark, "pages")
    jobs.run_to_end(jobs.visitor_sessions(stream), sessions, staging_path(spark, "ck"))
    jobs.run_to_end(jobs.slot_pages(stream), pages, staging_path(spark, "ck"))
    got = jobs.count_pages(spark.read.parquet(sessions), spark.read.parquet(pages)).collect()
    assert sorted((r["visitor"], r["hits"], r["pages"]) for r in got) == [("bot", 100_100, 100_000), ("x", 1, 1), ("x", 2, 1)]


def test_seam_states():
    day = jobs.DAY_MS
    seam = jobs.Seam(-(1 << 30), 0, [], [], "").with_days([10], [12, 13, 16, 9], 3 * day)
    assert (seam.starts, seam.ends, seam.first_missing()) == ([12, 16], [13, 16], 11)
    seam = seam.with_days([], [11, 14], 20 * day)
    assert (seam.starts, seam.ends, seam.first_missing()) == ([11, 16], [14, 16], 15)
    assert seam.next_ask(day, 9) == (21 * day, "extend")
    assert seam._replace(asked="extend").next_ask(day, 9) == (24 * day, "heal")
    assert seam._replace(asked="heal").next_ask(day, 9) is None
    # the archive moves on: what it holds is no recent day any more
    assert seam.with_days([16], [], 0).first_missing() == 17


def test_sketches_merge_to_the_people_of_a_day(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.range(20_000).select((F.lit(t0) + F.make_dt_interval(mins=(F.col("id") % 1300).cast("int"))).alias("ts"), (F.col("id") % 5000).cast("string").alias("visitor"), F.lit("N").alias("country"))
    source, out = staging_path(spark, "hits"), staging_path(spark, "buckets")
    rows.unionByName(rows.limit(1).withColumn("ts", F.lit(t0 + dt.timedelta(days=4)))).write.parquet(source)
    jobs.run_to_end(jobs.hit_buckets(spark.readStream.schema(rows.schema).parquet(source)), out, staging_path(spark, "ck"))
    got = {(r["grain"], r["start"]): r for r in jobs.people_rollup(spark.read.parquet(out)).collect()}
    for r in jobs.people_exact(rows).collect():
        mine = got[r["grain"], r["start"]]
        assert mine["hits"] == r["hits"] and abs(mine["people"] - r["people"]) <= 4 * jobs.SKETCH_ERROR * r["people"]
