"""Column rules against hand-computed values."""

import math

from pyspark.sql import functions as F

from isotherm.functions import bands, calendar, derive, geo, traffic, units
from isotherm.functions.rounding import half_even, half_up, snap
from isotherm.schemas import BAND_COLUMNS, LEVELS


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_rounding_conventions(spark):
    got = values(spark, e=half_even(F.lit(2.5)), o=half_even(F.lit(3.5)), u=half_up(F.lit(-0.5)), v=half_up(F.lit(0.5)))
    assert (got["e"], got["o"], got["u"], got["v"]) == (2.0, 4.0, 0.0, 1.0)
    got = values(spark, a=snap(F.lit(32.05)), b=snap(F.lit(-0.04)))
    assert got["a"] == 32.1 and math.copysign(1, got["b"]) == 1.0


def test_cell_keys_never_hold_negative_zero(spark):
    rows = [(51.5, -0.0, "51.5_0.0"), (32.1, 34.8, "32.1_34.8"), (-13.6, -172.6, "-13.6_-172.6"), (-0.1, 0.0, "-0.1_0.0")]
    df = spark.createDataFrame(rows, "lat DOUBLE, lon DOUBLE, want STRING")
    assert df.where(geo.cell_key(F.col("lat"), F.col("lon")) != F.col("want")).count() == 0


def test_leap_day_anchor_rolls_to_march(spark):
    got = values(spark, a=calendar.anchor(F.lit(2023), 2, 29), b=calendar.anchor(F.lit(2024), 2, 29))
    assert (str(got["a"]), str(got["b"])) == ("2023-03-01", "2024-02-29")


def test_season_window_does_not_wrap(spark):
    rows = [("1999-12-30", False), ("2000-01-04", True), ("2000-01-05", False)]
    df = spark.createDataFrame(rows, "d STRING, want BOOLEAN").withColumn("date", F.to_date("d"))
    assert df.where(calendar.in_season(F.col("date"), 1, 1, 3) != F.col("want")).count() == 0


def test_circle_has_365_days_in_every_year(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2023-01-01', DATE'2024-12-31')) AS date")
    got = df.agg(F.min(calendar.circle_doy(F.col("date"))), F.max(calendar.circle_doy(F.col("date"))), F.max(calendar.circle_week(F.col("date")))).first()
    assert tuple(got) == (0, 364, 51)


def band(spark, numbers):
    return spark.createDataFrame([tuple(float(x) for x in numbers)], ", ".join(f"{c} DOUBLE" for c in BAND_COLUMNS))


def test_interval_probability(spark):
    points = [F.col(c) for c in BAND_COLUMNS]

    def p(df, lo, hi):
        return df.select(bands.prob_interval(points, F.lit(float(lo)), F.lit(float(hi)))).first()[0]

    rising, dry = band(spark, range(9)), band(spark, [0] * 9)
    assert abs(p(rising, -1, 9) - 1) < 1e-9
    assert abs(p(rising, 4, 6) - 0.4) < 1e-9
    assert abs(p(rising, 6, math.inf) - 0.1) < 1e-9
    assert abs(p(dry, -1, 1) - 1) < 1e-9
    assert p(dry, 0.5, 5) == 0


def test_inverse_cdf_hits_its_anchors(spark):
    points = [F.col(c) for c in BAND_COLUMNS]
    df = band(spark, range(9))
    for i, u in enumerate(LEVELS):
        assert abs(df.select(bands.inverse_cdf(points, F.lit(u))).first()[0] - i) < 1e-9
    assert abs(df.select(bands.inverse_cdf(points, F.lit(0.15))).first()[0] - (2 + 0.05 / 0.15)) < 1e-9


def test_pinned_heads_are_monotone_and_keep_the_median(spark):
    df = band(spark, [3, 1, 2, 5, 4, 3, 6, 5, 9])
    row = df.select(*[h.alias(c) for h, c in zip(bands.pin_median([F.col(c) for c in BAND_COLUMNS]), BAND_COLUMNS)]).first()
    assert list(row) == sorted(row) and row["mid"] == 4


def test_record_position(spark):
    cases = [(20, 0, 40, 0.5), (0, 0, 0, 0.5), (2.5, 0, 0, 1.0), (-1, 0, 0, 0.0), (50, 0, 40, 1.0), (13, 0, 40, 0.3)]
    df = spark.createDataFrame([tuple(float(x) for x in c) for c in cases], "v DOUBLE, lo DOUBLE, hi DOUBLE, want DOUBLE")
    assert df.where(F.abs(derive.record_position(F.col("v"), F.col("lo"), F.col("hi")) - F.col("want")) > 1e-12).count() == 0


def test_units(spark):
    got = values(
        spark, f=units.convert(F.lit(100.0), "tmax", "imperial"), d=units.convert_delta(F.lit(1.0), "tmax", "imperial"),
        k=units.convert(F.lit(10.0), "wind", "metric"), w=units.bin_width("tmax", "metric", F.lit(26.0)), p=units.axis_pad("precip", "metric", F.lit(3.0)),
    )
    assert got["f"] == 212 and got["d"] == 1.8 and got["k"] == 36 and got["w"] == 1.0 and got["p"] == 1.0


def test_traffic_rules(spark):
    rows = [
        ("/10.5,20.5/2024-01-01/tmax", True, True, "tmax"), ("/10.5,20.5", False, False, None), ("/95,20/2024-01-01/tmax", True, False, "tmax"),
        ("/1,2/yesterday/tmax", True, False, "tmax"), ("/", False, False, None),
    ]
    df = spark.createDataFrame(rows, "page STRING, content BOOLEAN, ok BOOLEAN, metric STRING")
    page = F.col("page")
    wrong = (traffic.content_page(page) != F.col("content")) | (traffic.share_path(page) != F.col("ok")) | ~traffic.page_metric(page).eqNullSafe(F.col("metric"))
    assert df.where(wrong).count() == 0
    got = values(spark, a=traffic.text_match(F.lit("my TMAX page"), "tmax, wind"), b=traffic.text_match(F.lit("a bot"), "~bot"), c=traffic.text_match(F.lit(None), ""))
    assert (got["a"], got["b"], got["c"]) == (True, False, True)
