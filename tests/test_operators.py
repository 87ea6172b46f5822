"""Operators against brute force and known answers on small inputs."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isotherm.operators import calibrate, cells, climatology, daily, nearest, order_stats, pools, shuffles, spatial, tiers, traffic


@pytest.mark.parametrize("shape", ["spread", "outlier", "repeated", "narrow"])
def test_order_statistics_match_numpy(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "spread": np.where(rng.random(3000) < 0.35, 0.0, np.exp(rng.normal(size=3000) * 3) * rng.choice([-1.0, 1.0], 3000)),
        "outlier": np.append(rng.random(2999), 1e12),
        "repeated": np.where(rng.random(3000) < 0.9, 7.25, rng.normal(size=3000)),
        "narrow": 20 + rng.random(3000) * 1e-9,
    }[shape]
    frame = pd.DataFrame({"k": rng.integers(0, 3, 3000), "v": values})
    df = spark.createDataFrame(frame)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for row in order_stats.quantiles(df, ["k"], "v", probs).collect():
        assert np.allclose(row["q"], frame.v[frame.k == row["k"]].quantile(probs), rtol=1e-12)
    every = order_stats.order_statistics(df, [], "v", lambda n: F.sequence(F.lit(0).cast("long"), n - 1))
    assert [r["v"] for r in every.orderBy("i").collect()] == sorted(frame.v)
    one, many = (order_stats.quantiles(df.repartition(n), [], "v", probs).first()["q"] for n in (1, 13))
    assert one == many


def test_order_statistics_of_empty_null_and_infinite_values(spark):
    inf = float("inf")
    rows = [(None, 1.0), (None, 3.0), (1, None), (1, float("nan")), (1, inf), (1, -inf), (1, 0.0), (1, -0.0), (1, 1e305)]
    df = spark.createDataFrame(rows, "k INT, v DOUBLE")
    every = order_stats.order_statistics(df, ["k"], "v", lambda n: F.sequence(F.lit(0).cast("long"), n - 1))
    got = {(r["k"], r["i"]): r["v"] for r in every.collect()}
    assert got == {(None, 0): 1.0, (None, 1): 3.0, (1, 0): -inf, (1, 1): 0.0, (1, 2): 0.0, (1, 3): 1e305, (1, 4): inf}
    assert order_stats.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_an_outlier_leaves_the_parts_small(spark):
    """No part that is ordered holds more than a few of many distinct values."""
    df = spark.range(200_000).select((F.rand(5) * 30).alias("v")).unionByName(spark.createDataFrame([(1e12,)], "v DOUBLE"))
    slotted = df.withColumn("slot", order_stats._slot(F.col("v")))
    ends = slotted.groupBy("slot").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    parts = slotted.join(ends, "slot").groupBy("slot", order_stats._part(F.col("v"), F.col("low"), F.col("high"))).count()
    assert parts.agg(F.max("count")).first()[0] < 50


def test_global_row_number_equals_one_sort(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 7919) % 101)
    got = order_stats.global_row_number(df, F.floor(F.col("v") / 10), [F.col("v"), F.col("id")], "rn").collect()
    want = {r[0]: i + 1 for i, r in enumerate(sorted(((r["id"], r["v"]) for r in got), key=lambda x: (x[1], x[0])))}
    assert all(want[r["id"]] == r["rn"] for r in got)


@pytest.mark.parametrize("spread", [2.0, 80.0])
def test_nearest_is_exact(spark, spread):
    rng = random.Random(5)
    places = [(i, rng.uniform(-spread, spread), rng.uniform(-180, 180)) for i in range(60)]
    asks = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)] + [(900, 0.1, 179.99), (901, 89.9, 10.0)]
    q = spark.createDataFrame(asks, "qid INT, y DOUBLE, x DOUBLE")
    p = spark.createDataFrame(places, "pid INT, py DOUBLE, px DOUBLE")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    got = {r["qid"]: r for r in nearest.nearest(q, p, ["qid"], ["pid"], tie=["pid"]).collect()}
    assert len(got) == len(asks)
    for qid, y, x in asks:
        assert abs(got[qid]["dist"] - min(km(y, x, b, c) for _, b, c in places)) < 1e-6


def test_radius_join_is_exact_near_pole_and_dateline(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(200, 10.0, 179.9), (201, 10.0, -179.9), (202, 88.0, 0.0), (203, 88.0, 170.0)]
    q = spark.createDataFrame(pts, "qid INT, y DOUBLE, x DOUBLE")
    p = q.select(F.col("qid").alias("pid"), F.col("y").alias("py"), F.col("x").alias("px"))
    from isotherm.functions.geo import haversine_km

    want = {(r[0], r[1]) for r in q.crossJoin(p).where(haversine_km(F.col("y"), F.col("x"), F.col("py"), F.col("px")) <= 500).select("qid", "pid").collect()}
    got = [(r[0], r[1]) for r in spatial.within_radius(q, p, 500.0).select("qid", "pid").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (200, 201) in want


def test_land_snap(spark):
    land = [(0, r, c, (r, c) in {(0, 0), (4, 4)}) for r in range(5) for c in range(5)] + [(1, 0, 0, False)]
    targets = [(1, 0, 0, 0), (2, 0, 1, 1), (3, 0, 2, 2), (4, 0, 3, 4), (5, 1, 0, 0)]
    points = spark.createDataFrame(land, "tile LONG, row INT, col INT, land BOOLEAN")
    asked = spark.createDataFrame(targets, "cell_id LONG, tile LONG, row INT, col INT")
    got = {r["cell_id"]: (r["land_row"], r["land_col"]) for r in spatial.snap_to_land(asked, points).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (4, 4), 5: (None, None)}


def test_whole_local_days_with_known_answers(spark):
    start = dt.datetime(2023, 12, 31)
    rows = []
    for h in range(24 * 62):
        ts = start + dt.timedelta(hours=h)
        since_reset = (ts - dt.timedelta(hours=1)).hour + 1
        local_hour = (ts + dt.timedelta(hours=-6)).hour
        rows.append(("c", ts, 280.0 + local_hour, since_reset * 0.001, 3.0, 4.0))
    df = spark.createDataFrame(rows, "cell_key STRING, ts TIMESTAMP_NTZ, t2m DOUBLE, tp DOUBLE, u10 DOUBLE, v10 DOUBLE")
    local = daily.with_local_day(daily.hourly_wind(daily.deaccumulate(df)), F.lit(-6))
    days = daily.daily_metrics(local).orderBy("date").collect()
    assert len(days) == 61  # the two partial days at the ends are gone, Feb 29 stays
    assert dt.date(2024, 2, 29) in {d["date"] for d in days}
    for d in days[1:]:
        assert abs(d["tmax_C"] - d["tmin_C"] - 23.0) < 1e-9 and abs(d["precip_mm"] - 24.0) < 1e-6 and d["wind_max_ms"] == 5.0


def day_rows(spark, rows):
    return spark.createDataFrame([(k, dt.date.fromisoformat(d), *v) for k, d, *v in rows], "cell_key STRING, date DATE, tmax_C DOUBLE, dewpt_mean_C DOUBLE")


def test_column_merge_keeps_what_the_new_side_lacks(spark):
    old = day_rows(spark, [("c", "1950-01-01", 1.0, 5.0), ("c", "2026-05-30", 2.0, 6.0), ("c", "2026-05-31", 3.0, 7.0)])
    new = day_rows(spark, [("c", "2026-05-31", 30.0, None), ("c", "2026-06-01", 40.0, None)]).drop("dewpt_mean_C")
    merged = tiers.merge_columns(old, new)
    got = {str(r["date"]): (r["tmax_C"], r["dewpt_mean_C"]) for r in merged.collect()}
    assert got == {"1950-01-01": (1.0, 5.0), "2026-05-30": (2.0, 6.0), "2026-05-31": (30.0, 7.0), "2026-06-01": (40.0, None)}
    again = tiers.merge_columns(merged, new)
    assert {tuple(r) for r in again.select(*merged.columns).collect()} == {tuple(r) for r in merged.collect()}


def test_tier_merge_prefers_archive_then_recent(spark):
    rows = [("c", "2020-01-01", "forecast", 3.0), ("c", "2020-01-01", "archive", 1.0), ("c", "2020-01-02", "forecast", 3.0), ("c", "2020-01-02", "recent", 2.0)]
    df = spark.createDataFrame(rows, "cell_key STRING, date STRING, tier STRING, tmax_C DOUBLE")
    merged = tiers.merge_tiers(df)
    assert {(r["date"], r["tier"]) for r in merged.collect()} == {("2020-01-01", "archive"), ("2020-01-02", "recent")}
    assert tiers.merge_tiers(merged).count() == 2


def history(spark, years, offset=lambda y: 0.0, seed=1):
    rng, rows = random.Random(seed), []
    for y in years:
        for n in range(365):
            d = dt.date(y, 1, 1) + dt.timedelta(days=n)
            rows.append(("c", d, 10 + 10 * math.sin(n / 58) + rng.gauss(0, 2) + offset(y)))
    return spark.createDataFrame(rows, "cell_key STRING, date DATE, tmax_C DOUBLE")


def test_history_pools_match_brute_force(spark):
    df = history(spark, range(2000, 2006))
    targets = df.where("date IN (DATE'2005-02-28', DATE'2005-07-01', DATE'2004-02-29', DATE'2005-01-02')")
    days = [(r["date"], r["tmax_C"]) for r in df.collect()]
    got = pools.history_pools(df, targets, "tmax_C").collect()
    assert len(got) == targets.count()
    for r in got:
        past = [(d, v) for d, v in days if d < r["date"]]

        def anchor(y):
            return dt.date(y, r["date"].month, 1) + dt.timedelta(days=r["date"].day - 1)

        window = sorted(v for d, v in past if abs((d - anchor(d.year)).days) <= 3)
        assert r["n_all"] == len(past) and r["window"] == window
        assert r["top"] == sorted((v for _, v in past), reverse=True)[:11] and r["bottom"] == sorted(v for _, v in past)[:11]


def test_week_shuffle_sees_change_and_its_absence(spark):
    early, late = (1990, 1999), (2000, 2009)
    still = shuffles.week_shuffle_test(history(spark, range(1990, 2010)), "tmax_C", early, late, deals=300).first()
    warm = shuffles.week_shuffle_test(history(spark, range(1990, 2010), lambda y: 2.0 if y >= 2000 else 0.0), "tmax_C", early, late, deals=300).first()
    assert still["p_signed"] > 0.05 and warm["p_signed"] <= 0.01 and abs(warm["signed_gap"] - 2) < 0.7
    assert shuffles.week_shuffle_test(history(spark, range(1999, 2001)), "tmax_C", (1999, 1999), (2000, 2000), deals=10).isEmpty()


def test_block_test_bounds(spark):
    same = history(spark, range(1990, 2010), seed=2)
    apart = history(spark, range(1990, 2010), lambda y: 40.0 if y >= 2000 else 0.0)
    p_apart = shuffles.year_block_test(apart, "tmax_C", (1990, 1999), (2000, 2009), deals=200).first()
    p_same = shuffles.year_block_test(same, "tmax_C", (1990, 1999), (2000, 2009), deals=200).first()
    assert p_apart["p"] < 0.02 and p_apart["observed_diff"] > 15
    assert 1 / 201 <= p_same["p"] <= 1
    assert shuffles.year_block_test(same, "tmax_C", (1950, 1959), (2000, 2009), deals=10).isEmpty()


def test_records_take_the_first_of_equals(spark):
    df = spark.createDataFrame([("c", dt.date(2000, 1, d), v) for d, v in ((1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, 1.0))], "cell_key STRING, date DATE, v DOUBLE")
    row = climatology.records(df, "v").first()
    assert (row["high_date"].day, row["low_date"].day) == (2, 4)


def test_sessions_split_after_thirty_minutes_even_for_one_busy_visitor(spark):
    base = dt.datetime(2024, 1, 1)
    minutes = [0, 10, 40, 71, 72, 200] + [300 + i / 60 for i in range(600)]
    rows = [("v", base + dt.timedelta(minutes=m), f"/a/b/{i % 4}") for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "visitor STRING, ts TIMESTAMP_NTZ, page STRING")
    got = sorted((r["session"], r["hits"]) for r in traffic.sessions(df).collect())
    assert got == [(1, 3), (2, 2), (3, 1), (4, 600)]


def test_conformal_shift_covers_its_own_calibration_set(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"r": rng.normal(size=999)}))
    residuals = np.sort([x[0] for x in df.collect()])
    for row in calibrate.conformal_shifts(df, [], "r").collect():
        covered = (residuals <= row["shift"]).mean()
        assert abs(covered - row["level"]) <= 1 / 999 + 1e-9


def test_unique_names_are_unique_for_one_hot_label(spark):
    df = spark.range(300).select(
        F.col("id").alias("cell_id"), (F.col("id") % 20 / 10.0).alias("lat"), (F.floor(F.col("id") / 20) / 10.0).alias("lon"), (F.col("id") * 13 % 997).alias("population"), F.lit("Metro").alias("name")
    )
    named = cells.unique_names(df)
    assert named.select("unique_name").distinct().count() == 300
    assert named.where("unique_name = 'Metro'").first()["population"] == df.agg(F.max("population")).first()[0]


def test_bilinear_lookup_clamps_and_wraps(spark):
    heads = [f"{c} DOUBLE" for c in calibrate.DELTA_COLUMNS]
    rows = [("c", "tmax", d, h, *([float(d + h)] * 9)) for d in (1, 183) for h in (0.0, 10.0)]
    surface = spark.createDataFrame(rows, "cell_key STRING, var STRING, doy INT, hres DOUBLE, " + ", ".join(heads))
    asks = [(1, "c", "tmax", 1, 5.0, 6.0), (2, "c", "tmax", 92, 0.0, 92.0), (3, "c", "tmax", 183, 99.0, 193.0), (4, "c", "tmax", 274, 0.0, 92.0)]
    requests = spark.createDataFrame(asks, "id INT, cell_key STRING, var STRING, doy INT, value DOUBLE, want DOUBLE")
    got = {r["id"]: r["dmid"] for r in calibrate.bilinear_lookup(requests.drop("want"), surface, ["id"]).collect()}
    for i, *_, want in asks:
        assert abs(got[i] - want) < 1.0


def test_region_is_spliced_only_into_shared_labels(spark):
    rows = [(1, 0.0, 0.0, 5, "Springfield", "Illinois"), (2, 1.0, 1.0, 9, "Springfield", "Ohio"), (3, 2.0, 2.0, 1, "Cairo", "Cairo"), (4, 3.0, 3.0, 1, "Springfield", "")]
    df = spark.createDataFrame(rows, "cell_id LONG, lat DOUBLE, lon DOUBLE, population LONG, name STRING, admin STRING")
    got = {r["cell_id"]: r["unique_name"] for r in cells.unique_names(df, "name", region="admin").collect()}
    assert got == {1: "Springfield, Illinois", 2: "Springfield, Ohio", 3: "Cairo", 4: "Springfield"}


def test_cell_list_invariants(spark):
    rows = [(1, 0.0, 0.0, "A, Chad (NW)"), (2, 0.0, 0.0, "B, Chad"), (3, 1.0, 0.0, "C, Mali")]
    df = spark.createDataFrame(rows, "cell_id LONG, lat DOUBLE, lon DOUBLE, name STRING")
    assert cells.shared_coordinates(df).count() == 1
    assert cells.tail_counts(df, df).isEmpty()
    changed = df.withColumn("name", F.when(F.col("cell_id") == 3, "C, Chad").otherwise(F.col("name")))
    assert {(r["tail"], r["before"], r["after"]) for r in cells.tail_counts(df, changed).collect()} == {("Chad", 2, 3), ("Mali", 1, 0)}


def test_nearest_of_copies_follows_the_spots(spark, monkeypatch):
    """Copies at one spot meet once: 300 queries and 300 places at each of ten spots are ten queries and ten places."""
    q = spark.createDataFrame([(k, float(k % 10), 0.0) for k in range(3000)], "qid int, y double, x double")
    p = spark.createDataFrame([(k, float(k % 10) + 0.01, 0.0) for k in range(3000)], "pid int, py double, px double")
    pairs, real = [], nearest.candidates
    monkeypatch.setattr(nearest, "candidates", lambda *a, **k: pairs.append(real(*a, **k).count()) or real(*a, **k))
    got = nearest.nearest(q, p, ["qid"], ["pid"], tie=["pid"]).collect()
    assert len(got) == 3000 and all(r["pid"] == r["qid"] % 10 for r in got)
    assert sum(pairs) <= 100


def test_names_of_cells_at_one_spot_are_worked_out_once(spark, monkeypatch):
    cells = spark.createDataFrame([(k, 10.0, 20.0) for k in range(400)] + [(900, 10.0, 40.0)], "cell_id int, lat double, lon double")
    towns = spark.createDataFrame([(1, "A", 50, 7, 10.0, 20.01), (2, "B", 50, 8, 10.0, 20.02), (3, "Big", 900, 9, 10.0, 20.1)], "place_id int, name string, population int, cc int, lat double, lon double")
    pairs, real = [], spatial.within_radius
    monkeypatch.setattr(spatial, "within_radius", lambda *a, **k: pairs.append(real(*a, **k).count()) or real(*a, **k))
    got = {r["cell_id"]: (r["name"], r["cc"]) for r in spatial.name_cells(cells, towns).collect()}
    assert len(got) == 401 and got[5] == ("A, Big", 7) and got[900][1] == 9
    assert sum(pairs) <= 6


def test_labels_and_places_meet_by_classes(spark):
    labels = spark.createDataFrame([(k, 10.0, 20.0, "aB", 3) for k in range(200)] + [(900, 50.0, 90.0, "ab", 3)], "cell_id int, lat double, lon double, place string, country int")
    places = spark.createDataFrame([(k, "AB", 3 + k % 2, 10.0, 20.5) for k in range(200)] + [(500, "ab", 5, 10.0, 20.1)], "place_id int, name string, cc int, lat double, lon double")
    matches = spatial.places_named(labels, places, 100.0)
    assert matches.count() == 3  # two countries at one spot, and one place
    got = {r["cell_id"]: (r["matches"], r["agrees"], r["nearest_cc"]) for r in spatial.country_agreement(labels, matches).collect()}
    assert len(got) == 201 and got[7] == (201, True, 5) and got[900] == (0, None, None)


def test_quantile_bins_deal_no_rows_by_key(spark, monkeypatch):
    """A metric holds a third of all rows, so they must not meet their edges in one task."""
    from isotherm.operators import evaluate

    monkeypatch.setattr(evaluate, "quantiles", lambda *_: spark.createDataFrame([("m", [0.0, 2.0, 4.0])], "metric string, q array<double>"))
    rows = spark.createDataFrame([("m", float(k)) for k in range(5)], "metric string, v double")
    # without the hint this join would be dealt out
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        binned = evaluate.quantile_bins(rows, ["metric"], "v", 2)
        assert "hashpartitioning" not in binned._jdf.queryExecution().executedPlan().toString()
        assert {r["v"]: r["bin"] for r in binned.collect()} == {0.0: None, 1.0: 0, 2.0: 0, 3.0: 1, 4.0: 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
