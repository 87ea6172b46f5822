"""Whole-table scans, record blocks, weighted order statistics, the bilinear lookup and the nearest search, against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from isotherm.functions import geo
from isotherm.operators import calibrate, nearest, pools, prefix
from isotherm.operators import evaluate as ev
from isotherm.operators.order_stats import weighted_quantiles
from isotherm.schemas import BAND_COLUMNS, DELTA_COLUMNS, LEVELS


def test_scan_splits_ties(spark):
    random_ = random.Random(1)
    rows = [(k, random_.choice([0, 0, 0, 0, 5, 7])) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, v long").repartition(7)
    order = [F.col("v").desc(), F.col("key")]
    got = {r["key"]: r for r in prefix.scan(df, order, {"upto": F.col("v")}, parts=9).collect()}
    total, running = sum(v for _, v in rows), 0
    for i, (key, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        running += v
        assert (got[key]["row_number"], got[key]["rows"], got[key]["upto"], got[key]["upto_total"]) == (i, 3000, running, total)
    # four in six values are equal, and no part holds more than its share and a little
    sizes = [r["count"] for r in prefix.ranges(df, order, 9).groupBy("_part").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2 * 3000 / 9


def test_scan_of_nothing_and_of_equal_rows(spark):
    assert prefix.scan(spark.createDataFrame([], "v long"), [F.col("v")], {"s": F.col("v")}).collect() == []
    same = prefix.scan(spark.createDataFrame([(1,)] * 20, "v long"), [F.col("v")], {"s": F.col("v")}).collect()
    assert sorted((r["row_number"], r["s"]) for r in same) == [(k, k) for k in range(1, 21)]


@pytest.mark.parametrize("rows, count", [(103, 5), (3, 5), (10, 5), (1, 1)])
def test_equal_counts_are_ntile(spark, rows, count):
    df = spark.range(rows).select(F.col("id").alias("key"), (F.col("id") % 3).alias("v"))
    got = sorted((r["v"], r["key"], r["part"]) for r in prefix.equal_counts(df, [F.col("v"), F.col("key")], count, "part").collect())
    small, extra = divmod(rows, count)
    want = [p for p in range(1, count + 1) for _ in range(small + (p <= extra))]
    assert [g[2] for g in got] == want


def test_history_pools_by_hand(spark):
    random_ = random.Random(3)
    start = dt.date(1999, 11, 20)
    days = [start + dt.timedelta(days=k) for k in range(900)]
    rows = [("a", d, float(random_.randrange(-20, 30))) for d in days if random_.random() < 0.8] + [("b", days[0], 1.0), ("b", days[3], float("nan")), ("b", days[4], None)]
    asked = [("a", d) for d in days[::7]] + [("a", dt.date(2000, 2, 29)), ("a", dt.date(2001, 3, 1)), ("a", dt.date(1999, 1, 1)), ("a", dt.date(2010, 1, 2)), ("b", days[2]), ("c", days[5])]
    got = pools.history_pools(spark.createDataFrame(rows, "cell_key string, date date, v double"), spark.createDataFrame(asked, "cell_key string, date date"), "v", keep=4)
    found = {(r["cell_key"], r["date"]): r for r in got.collect()}
    assert len(found) == len(set(asked))
    for cell, day in set(asked):
        before = [(d, v) for c, d, v in rows if c == cell and d < day and v is not None and not math.isnan(v)]
        window = []
        for d, v in before:
            anchor = dt.date(d.year, day.month, 1) + dt.timedelta(days=day.day - 1)
            if abs((d - anchor).days) <= 3:
                window.append(v)
        values = sorted(v for _, v in before)
        row = found[cell, day]
        assert (row["n_all"], row["bottom"], row["top"], row["window"]) == (len(values), values[:4], values[::-1][:4], sorted(window))


def test_no_target_meets_its_history(spark):
    """The plan neither explodes the history over days nor frames it by a window."""
    rows = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1.0)], "cell_key string, date date, v double")
    plan = pools.history_pools(rows, rows, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "RangeFrame" not in plan


def test_weighted_quantiles(spark):
    random_ = random.Random(4)
    rows = [(random_.choice("xy"), float(random_.randrange(40)), random_.choice([0.0, 0.5, 1.25, 3.0])) for _ in range(2000)]
    probs = (0.05, 0.5, 0.95, 1.0)
    df = spark.createDataFrame(rows + [("x", None, 1.0), ("x", float("nan"), 1.0)], "k string, v double, w double")
    for r in weighted_quantiles(df, ["k"], "v", F.col("w"), probs).collect():
        own = sorted((v, w) for k, v, w in rows if k == r["k"] and w)
        total = sum(w for _, w in own)
        for p, q in zip(probs, r["q"]):
            assert q == next(v for v, _ in own if sum(w for u, w in own if u <= v) >= p * total - 1e-9)
        assert r["n"] == round(total * 1e6)


def plain_bilinear(points, day, value):
    hs, ds = sorted({h for _, h in points}), sorted({d for d, _ in points})
    v = min(max(value, hs[0]), hs[-1])
    j1 = sum(h < v for h in hs)
    j0 = max(j1 - 1, 0)
    d0 = max((d for d in ds if d <= day), default=ds[-1])
    d1 = min((d for d in ds if d >= day), default=ds[0])
    t = 0.0 if hs[j1] == hs[j0] else (v - hs[j0]) / (hs[j1] - hs[j0])
    span = (d1 - d0) % 365 or 1
    w = (day - d0) % 365 / span
    corners = [((d0, hs[j0]), (1 - w) * (1 - t)), ((d0, hs[j1]), (1 - w) * t), ((d1, hs[j0]), w * (1 - t)), ((d1, hs[j1]), w * t)]
    return sum(points[c] * x for c, x in corners if c in points and x), any(c in points for c, x in corners if x)


@pytest.mark.parametrize("missing", [0, 9])
def test_bilinear_by_hand(spark, missing):
    random_ = random.Random(5)
    points = {(d, h): random_.uniform(-3, 3) for d in (1, 92, 183, 274) for h in (-5.0, 0.0, 10.0, 40.0)}
    for gone in random_.sample(sorted(points), missing):
        del points[gone]
    heads = ", ".join(f"{c} double" for c in DELTA_COLUMNS)
    surface = spark.createDataFrame([("a", "tmax", d, h, *[x + k for k in range(9)]) for (d, h), x in points.items()], f"cell_key string, var string, doy int, hres double, {heads}")
    asked = [(k, "a", "tmax", random_.randrange(1, 366), random_.uniform(-20, 60)) for k in range(300)] + [(900, "a", "tmax", 92, 10.0), (901, "b", "tmax", 1, 1.0)]
    got = {r["id"]: r for r in calibrate.bilinear_lookup(spark.createDataFrame(asked, "id int, cell_key string, var string, doy int, value double"), surface, ["id"]).collect()}
    for k, cell, _, day, value in asked:
        want, known = plain_bilinear(points, day, value) if cell == "a" else (0, False)
        assert (k in got) == known
        if known:
            assert math.isclose(got[k]["d01"], want, abs_tol=1e-9)


@pytest.mark.parametrize("metric", [nearest.Sphere(), nearest.Plane()])
def test_nearest_by_brute_force(spark, metric):
    random_ = random.Random(6)
    places = [(k, random_.uniform(-60, 70), random_.uniform(-180, 180)) for k in range(40)] + [(100, 0.0, 179.9), (101, 0.0, -179.9), (102, 10.0, 10.0), (103, 10.0, 10.0)]
    queries = [(k, random_.uniform(-85, 85), random_.uniform(-180, 180)) for k in range(200)] + [(500, 0.0, 180.0), (501, 10.0, 10.2), (502, 89.9, 0.0)]
    q = spark.createDataFrame(queries, "id int, y double, x double")
    p = spark.createDataFrame(places, "pid int, py double, px double")
    got = {r["id"]: r for r in nearest.nearest(q, p, ["id"], ["pid"], metric, tie=["pid"]).collect()}
    pairs = q.crossJoin(p).withColumn("d", metric.distance(F.col("y"), F.col("x"), F.col("py"), F.col("px")))
    want = {r["id"]: r["b"] for r in pairs.groupBy("id").agg(F.min(F.struct("d", "pid")).alias("b")).collect()}
    assert len(got) == len(queries)
    for k, best in want.items():
        assert (got[k]["dist"], got[k]["pid"]) == (best["d"], best["pid"])


def test_nearest_tie_at_the_edge_of_the_buckets(spark):
    """On a plane the place just outside the buckets is exactly as far as the one inside, and has the smaller key."""
    q = spark.createDataFrame([(1, 0.0, 0.0)], "id int, y double, x double")
    p = spark.createDataFrame([(9, 0.5, 0.0), (2, 0.0, -0.5)], "pid int, py double, px double")
    assert nearest.nearest(q, p, ["id"], ["pid"], nearest.Plane(), sizes=(0.5,), tie=["pid"]).first()["pid"] == 2
    assert geo.EARTH_KM > 6000


def test_predictive_density_by_hand(spark):
    random_ = random.Random(8)
    bands = [sorted(random_.uniform(-5, 5) for _ in BAND_COLUMNS) for _ in range(4)] + [[1.5] * 9]
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(bands)], "id int, " + ", ".join(f"{c} double" for c in BAND_COLUMNS))
    for row in ev.predictive_density(df, BAND_COLUMNS, axis_span=30.0).collect():
        heads = bands[row["id"]]

        def inverse(u):
            for a, b, p, q in zip(heads, heads[1:], LEVELS, LEVELS[1:]):
                if u <= q:
                    return a + (max(u, p) - p) / (q - p) * (b - a)
            return heads[-1]

        read = [inverse(LEVELS[0] + (LEVELS[-1] - LEVELS[0]) * (j + 0.5) / 300) for j in range(300)]
        mean = sum(read) / 300
        deviation = math.sqrt(sum((x - mean) ** 2 for x in read) / 299)
        at = lambda s: read[int(s * 299)] * (1 - s * 299 % 1) + read[int(s * 299) + 1] * (s * 299 % 1)
        span = read[-1] - read[0]
        flat = span < 1e-9
        width = 30.0 / 28 if flat else max(0.9 * min(x for x in (deviation, (at(0.75) - at(0.25)) / 1.349) if x) * 300**-0.2, span / 60)
        margin = width * (4 if flat else 1.2)
        low, high = read[0] - margin, read[-1] + margin
        for i, point in enumerate(row["curve"]):
            t = low + (high - low) * i / 90
            mass = sum(math.exp(-0.5 * ((t - x) / width) ** 2) for x in read)
            assert math.isclose(point["t"], t, abs_tol=1e-9)
            assert math.isclose(point["d"], mass / 300 if flat else mass / (width * 300 * math.sqrt(2 * math.pi)), rel_tol=1e-7, abs_tol=1e-12)


def test_predictive_density_is_worked_out_in_arrays(spark):
    """27,300 kernel values a band: none of them is a lambda call. Readings far outside a place's reach add nothing, a missing head leaves no heights."""
    bands = [[-1000.0] + [0.0] * 7 + [1000.0], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 1e6], [1.0] * 8 + [None]]
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(bands)], "id int, " + ", ".join(f"{c} double" for c in BAND_COLUMNS))
    out = ev.predictive_density(df, BAND_COLUMNS, axis_span=30.0)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    curves = {r["id"]: r["curve"] for r in out.collect()}
    for k in (0, 1):
        step = (curves[k][-1]["t"] - curves[k][0]["t"]) / 90
        assert len(curves[k]) == 91 and math.isclose(sum(p["d"] for p in curves[k]) * step, 1, abs_tol=0.1)
    assert all(p["t"] is None and p["d"] is None for p in curves[2])


def test_history_pools_take_one_shuffle(spark):
    """Targets carry their columns through the walk of their cell: no join, and a cell that nobody asks for has no rows."""
    days = [dt.date(2000, 1, k) for k in (1, 2, 3)]
    rows = spark.createDataFrame([("a", d, float(k)) for k, d in enumerate(days)] + [("b", days[0], 9.0)], "cell_key string, date date, v double")
    asked = spark.createDataFrame([("a", days[2], "x"), ("a", days[2], "y"), ("a", None, "z")], "cell_key string, date date, tag string")
    pooled = pools.history_pools(rows, asked, "v", carried=["tag"])
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {r["tag"]: (r["date"], r["n_all"], r["top"], r["bottom"], r["window"]) for r in pooled.collect()}
    assert got == {"x": (days[2], 2, [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]), "y": (days[2], 2, [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]), "z": (None, 0, [], [], [])}


def test_pairs_are_aggregated_once_where_roles_are_made(spark):
    """Views made after the roles read the stored pairs, not the line items again."""
    from isotherm.sources.tables import Tables

    db = Tables(spark, "/root/testdata/sf0.001")
    assert db.roles.count() == db.banded.count()
    for view in (db.banded, db.wet_pairs):
        assert not any("lineitem" in f for f in view.inputFiles())
