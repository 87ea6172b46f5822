"""Climatology, ranks, claims and shuffle tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.functions import bands as band_fn
from isotherm.functions import calendar
from isotherm.functions.rounding import r6
from isotherm.operators import climatology as clim
from isotherm.operators import pools, shuffles, tiers
from isotherm.plans.columns import SEASON_SQL, TARGET, in_window, target
from isotherm.plans.registry import query
from isotherm.schemas import BAND_COLUMNS, LEVELS
from isotherm.session import materialize

COMPARABLE = f"NOT (tier = 'forecast' AND date > DATE '{TARGET}')"


def season_pool(db):
    """The season's window without forecasts beyond the target day."""
    return in_window(db).where(tiers.comparable(F.col("tier"), F.col("date"), target()))


def observed_window(db, metric="tmax"):
    return in_window(db).where(tiers.observed(F.col("tier"), metric))


_YEARLY = "quantile_cont(tmax_C, [0.1, 0.25, 0.5, 0.75, 0.9])"
YEARLY_SQL = f"""(SELECT cell_key, CAST(year(date) AS INT) AS year, q[1] AS p10, q[2] AS p25, q[3] AS p50, q[4] AS p75, q[5] AS p90 FROM (
   SELECT cell_key, min(date) AS date, {_YEARLY} AS q FROM cell_day WHERE {SEASON_SQL} AND {COMPARABLE} GROUP BY cell_key, year(date)))"""


@query("yearly_bands", f"SELECT cell_key, year, R6(p10) AS p10, R6(p25) AS p25, R6(p50) AS p50, R6(p75) AS p75, R6(p90) AS p90 FROM {YEARLY_SQL}")
def yearly_bands(db):
    rows = clim.yearly_bands(season_pool(db), "tmax_C")
    return rows.select("cell_key", "year", *[r6(F.col(c)).alias(c) for c in clim.YEARLY])


_FRAME = "(PARTITION BY cell_key ORDER BY year ROWS BETWEEN {} AND {})"


def _moving(col, lo, hi, size):
    frame = _FRAME.format(lo, hi)
    return f"R6(CASE WHEN count(*) OVER {frame} = {size} THEN quantile_cont({col}, 0.5) OVER {frame} END)"


@query(
    "rolling_median",
    f"""SELECT cell_key, year, {_moving('p50', '2 PRECEDING', '2 FOLLOWING', 5)} AS moving_p50, {_moving('p10', '2 PRECEDING', '2 FOLLOWING', 5)} AS moving_p10,
        {_moving('p50', '4 PRECEDING', 'CURRENT ROW', 5)} AS trailing_p50 FROM {YEARLY_SQL}""",
)
def rolling_median(db):
    years = clim.yearly_bands(season_pool(db), "tmax_C")
    moved = clim.rolling_median(years, ["p50", "p10"])
    trailing = clim.rolling_median(years, ["p50"], trailing=5).select("cell_key", "year", F.col("moving_p50").alias("trailing_p50"))
    joined = moved.join(trailing, ["cell_key", "year"])
    return joined.select("cell_key", "year", *[r6(F.col(c)).alias(c) for c in ("moving_p50", "moving_p10", "trailing_p50")])


OBSERVED = "tier <> 'forecast'"


@query(
    "records",
    f"""SELECT h.cell_key, high_date, high, low_date, low FROM
          (SELECT cell_key, date AS high_date, tmax_C AS high FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY tmax_C DESC, date) AS rn FROM cell_day WHERE {OBSERVED}) WHERE rn = 1) h
          JOIN (SELECT cell_key, date AS low_date, tmax_C AS low FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY tmax_C, date) AS rn FROM cell_day WHERE {OBSERVED}) WHERE rn = 1) l
          ON h.cell_key = l.cell_key""",
)
def records(db):
    return clim.records(db.cell_day.where(tiers.observed(F.col("tier"), "tmax")), "tmax_C")


RANK_SQL = f"""(SELECT t.cell_key, any_value(t.tmax_C) AS x, count_if(p.tmax_C >= t.tmax_C) AS rank_high, count_if(p.tmax_C <= t.tmax_C) AS rank_low,
     count_if(p.tmax_C > t.tmax_C) AS above, count(p.tmax_C) AS total
   FROM (SELECT cell_key, tmax_C FROM cell_day WHERE date = DATE '{TARGET}') t JOIN (SELECT * FROM cell_day WHERE {SEASON_SQL} AND {OBSERVED}) p ON t.cell_key = p.cell_key GROUP BY 1)"""


def ranks(db):
    day = db.cell_day.where(F.col("date") == target()).select("cell_key", F.col("tmax_C").alias("x"))
    return pools.rank_value(observed_window(db), day, "tmax_C", "x")


@query(
    "rank_value",
    f"""SELECT cell_key, x, rank_high, rank_low, above, total, rank_high <= rank_low AS high_side, R6(least(rank_high, rank_low) / total) AS single_tail FROM {RANK_SQL}""",
)
def rank_value(db):
    return ranks(db).withColumn("single_tail", r6(F.col("single_tail")))


@query("pct_higher", f"SELECT cell_key, R6(100.0 * above / total) AS pct_higher, R6(100.0 * (total - rank_low) / total) AS beyond_high FROM {RANK_SQL}")
def pct_higher(db):
    r = ranks(db)
    return r.select("cell_key", r6(100.0 * F.col("above") / F.col("total")).alias("pct_higher"), r6(100.0 * (F.col("total") - F.col("rank_low")) / F.col("total")).alias("beyond_high"))


@query(
    "context_bucket",
    f"""WITH d AS (SELECT * FROM cell_day), p AS (SELECT cell_key, month(date) AS mo, precip_mm FROM cell_day WHERE tier = 'archive'),
      s AS (SELECT d.cell_key, d.date, d.precip_mm, 100.0::DOUBLE * count_if(p.precip_mm > d.precip_mm) / count(*) AS a FROM d JOIN p ON d.cell_key = p.cell_key AND month(d.date) = p.mo GROUP BY 1, 2, 3)
      SELECT cell_key, date, CASE WHEN precip_mm = 0 THEN 'driest' WHEN 100 - a <= 5 THEN 'extreme_low' WHEN a <= 5 THEN 'extreme_high' WHEN 100 - a <= 10 THEN 'strong_low' WHEN a <= 10 THEN 'strong_high'
             WHEN 100 - a <= 20 THEN 'mild_low' WHEN a <= 20 THEN 'mild_high' ELSE 'normal' END AS bucket FROM s""",
)
def context_bucket(db):
    # equal values of a month share one row, and a running count replaces any pairing of days
    month = F.month("date").alias("mo")
    pool = db.cell_day.where("tier = 'archive'").groupBy("cell_key", month, "precip_mm").agg(F.count(F.lit(1)).alias("_n"))
    asked = db.cell_day.select("cell_key", month, "precip_mm").distinct().withColumn("_n", F.lit(0).cast("long"))
    steps = pool.unionByName(asked).groupBy("cell_key", "mo", "precip_mm").agg(F.sum("_n").alias("_n"))
    above = Window.partitionBy("cell_key", "mo").orderBy(F.col("precip_mm").desc()).rowsBetween(Window.unboundedPreceding, -1)
    share = 100.0 * F.coalesce(F.sum("_n").over(above), F.lit(0)) / F.sum("_n").over(Window.partitionBy("cell_key", "mo"))
    shares = steps.withColumn("a", share).drop("_n")
    days = db.cell_day.select("cell_key", "date", month, "precip_mm")
    return days.join(shares, ["cell_key", "mo", "precip_mm"]).select(
        "cell_key", "date", pools.context_bucket(F.col("a"), F.col("precip_mm"), "precip").alias("bucket")
    )


@query(
    "tail_value",
    f"""SELECT cell_key, s[least(n - 1, greatest(0, CAST(floor(0.9::DOUBLE * n) AS INT))) + 1] AS high_cut, s[least(n - 1, greatest(0, CAST(ceil(0.1::DOUBLE * n) AS INT) - 1)) + 1] AS low_cut
        FROM (SELECT cell_key, list_sort(list(tmax_C)) AS s, CAST(count(*) AS INT) AS n FROM cell_day WHERE {SEASON_SQL} AND {OBSERVED} GROUP BY 1)""",
)
def tail_value(db):
    pool = observed_window(db).groupBy("cell_key").agg(pools.sorted_pool("tmax_C").alias("pool"))
    share = F.lit(0.1)
    return pool.select(
        "cell_key", pools.tail_value(F.col("pool"), share, F.lit(True)).alias("high_cut"), pools.tail_value(F.col("pool"), share, F.lit(False)).alias("low_cut")
    )


@query("extents", "SELECT cell_key, min(date) AS first_date, max(date) AS last_date, min(tmax_C) AS low, max(tmax_C) AS high FROM cell_day GROUP BY 1")
def extents(db):
    return clim.extents(db.cell_day, "tmax_C")


@query("available_years", "SELECT DISTINCT cell_key, CAST(year(date) AS INT) AS year FROM cell_day")
def available_years(db):
    return clim.available_years(db.cell_day)


AXIS_SQL = f"""(SELECT cell_key, lo - 2 AS dl, hi + 2 AS dh, CASE WHEN (hi - lo + 4) / 0.5 <= 50 THEN 0.5::DOUBLE WHEN hi - lo + 4 <= 50 THEN 1.0 WHEN (hi - lo + 4) / 2 <= 50 THEN 2.0 ELSE 5.0 END AS bin
   FROM (SELECT cell_key, min(tmax_C) AS lo, max(tmax_C) AS hi FROM cell_day WHERE {SEASON_SQL} GROUP BY 1))"""


@query(
    "histogram",
    f"""WITH e AS (SELECT cell_key, bin, unnest(range(CAST(floor(dl / bin) AS INT), CAST(ceil(dh / bin) AS INT))) AS b FROM {AXIS_SQL}),
      c AS (SELECT d.cell_key, floor(tmax_C / bin) AS b, count(*) AS n FROM cell_day d JOIN {AXIS_SQL} a ON d.cell_key = a.cell_key WHERE {SEASON_SQL} AND {OBSERVED} GROUP BY 1, 2)
      SELECT e.cell_key, e.b * bin AS low, e.b * bin + bin AS high, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.cell_key = c.cell_key AND e.b = c.b""",
)
def histogram(db):
    axis = clim.bin_axis(in_window(db), "tmax_C", "tmax")
    return clim.histogram(observed_window(db), axis, "tmax_C")


@query(
    "period_histogram",
    f"""WITH p AS (SELECT * FROM (VALUES ('1995-1996', 1995, 1996), ('1997-1998', 1997, 1998), ('1999-2000', 1999, 2000)) v(period, a, z)),
      e AS (SELECT cell_key, bin, period, a, z, unnest(range(CAST(floor(dl / bin) AS INT), CAST(ceil(dh / bin) AS INT))) AS b FROM {AXIS_SQL}, p),
      v AS (SELECT cell_key, period, tmax_C FROM cell_day, p WHERE year(date) BETWEEN a AND z AND {SEASON_SQL} AND tier <> 'forecast'),
      c AS (SELECT v.cell_key, period, floor(tmax_C / bin) AS b, count(*) AS n FROM v JOIN {AXIS_SQL} x ON v.cell_key = x.cell_key GROUP BY 1, 2, 3),
      m AS (SELECT cell_key, period, quantile_cont(tmax_C, 0.5) AS median, count(*) AS days FROM v GROUP BY 1, 2)
      SELECT e.cell_key, e.period, e.b * bin AS low, e.b * bin + bin AS high, coalesce(n, 0) AS n, days, R6(median) AS median
      FROM e LEFT JOIN c ON e.cell_key = c.cell_key AND e.b = c.b AND e.period = c.period LEFT JOIN m ON m.cell_key = e.cell_key AND m.period = e.period""",
)
def period_histogram(db):
    periods = clim.consecutive_periods(2000, length=2)
    axis = clim.bin_axis(in_window(db), "tmax_C", "tmax")
    pool = in_window(db).where("tier <> 'forecast'").withColumn("period", clim.period_of(F.year("date"), periods)).where("period IS NOT NULL")
    labels = db.spark.createDataFrame([(p.label,) for p in periods], "period STRING")
    bars = clim.histogram(pool, axis, "tmax_C", ["period"], labels)
    middle = pool.groupBy("cell_key", "period").agg(F.count(F.lit(1)).alias("days"), r6(F.percentile("tmax_C", F.lit(0.5))).alias("median"))
    return bars.join(middle, ["cell_key", "period"], "left")


@query(
    "share_partition",
    f"""WITH p AS (SELECT cell_key, list_sort(list(tmax_C)) AS s, CAST(count(*) AS INT) AS n FROM cell_day WHERE {SEASON_SQL} AND {OBSERVED} GROUP BY 1),
      c AS (SELECT cell_key, s, n, s[least(n - 1, greatest(0, CAST(ceil(0.2::DOUBLE * n) AS INT) - 1)) + 1] AS a, s[least(n - 1, greatest(0, CAST(floor(0.8::DOUBLE * n) AS INT))) + 1] AS b FROM p),
      r AS (SELECT cell_key, floor(100.0::DOUBLE * len(list_filter(s, lambda v: v < a)) / n + 0.5) AS p0, floor(100.0::DOUBLE * len(list_filter(s, lambda v: v >= a AND v < b)) / n + 0.5) AS p1 FROM c)
      SELECT cell_key, 0 AS slice, CAST(p0 AS BIGINT) AS pct FROM r UNION ALL SELECT cell_key, 1, CAST(p1 AS BIGINT) FROM r UNION ALL SELECT cell_key, 2, CAST(100 - p0 - p1 AS BIGINT) FROM r""",
)
def share_partition(db):
    pool = observed_window(db)
    values = pool.groupBy("cell_key").agg(pools.sorted_pool("tmax_C").alias("s"))
    share = F.lit(0.2)
    pivots = values.select(
        "cell_key", F.array(pools.tail_value(F.col("s"), share, F.lit(False)), pools.tail_value(F.col("s"), share, F.lit(True))).alias("pivots")
    )
    return clim.share_partition(pool, pivots, "tmax_C")


HALVES = clim.split_periods(1995, 2000)
_DOY = "CAST(floor((dayofyear(date) - 1) / dayofyear(make_date(year(date), 12, 31))::DOUBLE * 365) AS INT)"
_DIAL_LEVELS = "[0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]"
_SMOOTHED = ", ".join(f"avg(b.q[{i + 1}]) AS {c}" for i, c in enumerate(clim.DIAL))
DOY_SQL = f"""(WITH d AS MATERIALIZED (SELECT cell_key, CASE WHEN year(date) <= 1997 THEN 'early' ELSE 'late' END AS period, {_DOY} AS doy, quantile_cont(tmax_C, {_DIAL_LEVELS}) AS q
     FROM cell_day WHERE tier = 'archive' AND year(date) BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3)
   SELECT a.cell_key, a.period, a.doy, {_SMOOTHED} FROM d a JOIN d b ON a.cell_key = b.cell_key AND a.period = b.period
     AND least((a.doy - b.doy + 365) % 365, (b.doy - a.doy + 365) % 365) <= 7 GROUP BY 1, 2, 3)"""


def archive_bands(db):
    return clim.doy_bands(db.cell_day.where("tier = 'archive'"), "tmax_C", HALVES, radius=7)


@query("doy_bands", f"SELECT cell_key, period, doy, {', '.join(f'R6({c}) AS {c}' for c in clim.DIAL)} FROM {DOY_SQL}")
def doy_bands(db):
    return archive_bands(db).select("cell_key", "period", "doy", *[r6(F.col(c)).alias(c) for c in clim.DIAL])


@query(
    "circular_smooth",
    f"""WITH d AS (SELECT cell_key, {_DOY} AS doy, avg(tmax_C) AS v FROM cell_day GROUP BY 1, 2)
      SELECT a.cell_key, a.doy, R6(avg(b.v)) AS v FROM d a JOIN d b ON a.cell_key = b.cell_key AND least((a.doy - b.doy + 365) % 365, (b.doy - a.doy + 365) % 365) <= 15 GROUP BY 1, 2""",
)
def circular_smooth(db):
    daily = db.cell_day.groupBy("cell_key", calendar.circle_doy(F.col("date")).alias("doy")).agg(F.avg("tmax_C").alias("v"))
    return clim.circular_smooth(daily, ["cell_key"], ["v"], 15).withColumn("v", r6(F.col("v")))


@query(
    "circular_median",
    f"""WITH d AS (SELECT cell_key, {_DOY} AS doy, tmax_C FROM cell_day WHERE tier = 'archive')
      SELECT cell_key, CAST((doy + k + 365) % 365 AS INT) AS doy, R6(quantile_cont(tmax_C, 0.5)) AS median FROM d, (SELECT CAST(range AS INT) AS k FROM range(-3, 4)) GROUP BY 1, 2""",
)
def circular_median(db):
    rows = clim.pooled_circular_median(db.cell_day.where("tier = 'archive'"), "tmax_C")
    return rows.withColumn("median", r6(F.col("median")))


@query(
    "outliers",
    f"""WITH r AS (SELECT cell_key, date, CASE WHEN year(date) <= 1997 THEN 'early' ELSE 'late' END AS period, {_DOY} AS doy, tmax_C AS value FROM cell_day WHERE tier = 'archive' AND year(date) BETWEEN 1995 AND 2000)
      SELECT r.cell_key, r.date, r.period, r.doy, value FROM r JOIN {DOY_SQL} b ON r.cell_key = b.cell_key AND r.period = b.period AND r.doy = b.doy WHERE value < round(p01, 6) OR value > round(p99, 6)""",
)
def outliers(db):
    bands = archive_bands(db).withColumn("p01", F.round("p01", 6)).withColumn("p99", F.round("p99", 6))
    return clim.outliers(db.cell_day.where("tier = 'archive'"), bands, "tmax_C", HALVES)


@query(
    "drawn_extent",
    f"""WITH b AS MATERIALIZED (SELECT * FROM {DOY_SQL}), r AS (SELECT cell_key, CASE WHEN year(date) <= 1997 THEN 'early' ELSE 'late' END AS period, {_DOY} AS doy, tmax_C AS value FROM cell_day WHERE tier = 'archive' AND year(date) BETWEEN 1995 AND 2000),
      o AS (SELECT r.cell_key, value FROM r JOIN b ON r.cell_key = b.cell_key AND r.period = b.period AND r.doy = b.doy WHERE value < round(p01, 6) OR value > round(p99, 6)),
      u AS (SELECT cell_key, p01 AS l, p99 AS h FROM b UNION ALL SELECT cell_key, value, value FROM o)
      SELECT cell_key, R6(min(l)) AS low, R6(max(h)) AS high FROM u GROUP BY 1""",
)
def drawn_extent(db):
    ext = clim.drawn_extent(archive_bands(db), outliers(db), ["p01", "p50", "p99"])
    return ext.select("cell_key", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(
    "diff_ribbon",
    f"""WITH b AS MATERIALIZED (SELECT * FROM {DOY_SQL}), j AS (SELECT e.cell_key, e.doy, e.p50 AS early, l.p50 AS late, e.doy / 365.0::DOUBLE AS frac FROM b e JOIN b l ON e.cell_key = l.cell_key AND e.doy = l.doy AND e.period = 'early' AND l.period = 'late'),
      f AS (SELECT * FROM j UNION ALL SELECT cell_key, doy, early, late, 1.0 FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY doy) AS rn FROM j) WHERE rn = 1)
      SELECT cell_key, doy, R6(early) AS early, R6(late) AS late, R6(frac) AS frac, CASE WHEN round(late, 6) > round(early, 6) THEN 'late' WHEN round(early, 6) > round(late, 6) THEN 'early' ELSE 'equal' END AS higher FROM f""",
)
def diff_ribbon(db):
    medians = archive_bands(db).select("cell_key", "period", "doy", F.round("p50", 6).alias("p50"))
    rows = clim.diff_ribbon(medians)
    return rows.select("cell_key", "doy", *[r6(F.col(c)).alias(c) for c in ("early", "late", "frac")], "higher")


@query("monthly_summary", "SELECT cell_key, CAST(month(date) AS INT) AS month, R6(quantile_cont(tmax_C, 0.5)) AS median, min(tmax_C) AS low, max(tmax_C) AS high FROM cell_day WHERE tier <> 'forecast' GROUP BY 1, 2")
def monthly_summary(db):
    rows = clim.monthly_summary(db.cell_day.where(tiers.observed(F.col("tier"), "tmax")), "tmax_C")
    return rows.withColumn("median", r6(F.col("median")))


@query("exceed_days", "SELECT cell_key, CAST(year(date) AS INT) AS year, count_if(tmax_C >= 45) AS days, max(tmax_C) AS highest FROM cell_day GROUP BY 1, 2")
def exceed_days(db):
    return clim.exceed_days(db.cell_day, "tmax_C", 45.0)


@query("yearly_max", "SELECT cell_key, CAST(year(date) AS INT) AS year, max(wind_max_ms) AS highest FROM cell_day GROUP BY 1, 2")
def yearly_max(db):
    return clim.exceed_days(db.cell_day, "wind_max_ms", 0.0).select("cell_key", "year", "highest")


EARLY, LATE = (1995, 1997), (1998, 2000)
_WEEK = f"least(51, {_DOY} // 7)"
WEEK_ROWS = f"(SELECT cell_key, CAST(year(date) AS INT) AS y, {_WEEK} AS w, tmax_C AS v FROM cell_day WHERE tier = 'archive' AND year(date) BETWEEN 1995 AND 2000)"


@query(
    "weekly_gap",
    f"""WITH s AS (SELECT *, y <= 1997 AS early FROM {WEEK_ROWS}),
      k AS (SELECT cell_key, w, quantile_cont(CASE WHEN early THEN v END, 0.5) AS e, quantile_cont(CASE WHEN NOT early THEN v END, 0.5) AS l FROM s GROUP BY 1, 2),
      p AS (SELECT k.cell_key, k.w, e, l, 100 * avg(CASE WHEN v < l THEN 1.0::DOUBLE WHEN v = l THEN 0.5 ELSE 0 END) AS pct FROM k JOIN s ON s.cell_key = k.cell_key AND s.w = k.w AND early WHERE e IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2, 3, 4)
      SELECT cell_key, count(*) AS weeks, R6(avg(l - e)) AS signed_gap, R6(avg(abs(l - e))) AS abs_gap, R6(avg(pct)) AS percentile FROM p GROUP BY 1 HAVING count(*) >= 8""",
)
def weekly_gap(db):
    rows = shuffles.weekly_gap(db.cell_day.where("tier = 'archive'"), "tmax_C", EARLY, LATE)
    return rows.select("cell_key", "weeks", *[r6(F.col(c)).alias(c) for c in ("signed_gap", "abs_gap", "percentile")])


WEEK_DEALS, BLOCK_DEALS = 2_000, 10_000


def dealt_sql(deals: int) -> str:
    """``d``: each different pile once, with the number of deals that gave it."""
    return f"""e AS (SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY md5(concat('42:', p, ':', y))) <= 3 AS early FROM (SELECT range AS p FROM range(0, {deals})), (SELECT CAST(range AS INT) AS y FROM range(1995, 2001))),
      f AS (SELECT min(p) AS p, count(*) AS times FROM (SELECT p, string_agg(y, ',' ORDER BY y) AS pile FROM e WHERE early GROUP BY p) GROUP BY pile),
      d AS (SELECT e.p, y, early, times FROM e JOIN f ON f.p = e.p),
      a AS MATERIALIZED (SELECT * FROM d UNION ALL SELECT -1, CAST(range AS INT), range <= 1997, 1 FROM range(1995, 2001))"""


@query(
    "year_shuffle_test",
    f"""WITH s AS MATERIALIZED (SELECT * FROM {WEEK_ROWS}), {dealt_sql(WEEK_DEALS)},
      k AS (SELECT p, cell_key, w, any_value(times) AS times, quantile_cont(CASE WHEN early THEN v END, 0.5) AS e, quantile_cont(CASE WHEN NOT early THEN v END, 0.5) AS l FROM s JOIN a ON s.y = a.y GROUP BY 1, 2, 3),
      g AS (SELECT p, cell_key, any_value(times) AS times, avg(l - e) AS sg, avg(abs(l - e)) AS ag, count(*) AS n FROM k WHERE e IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2),
      o AS (SELECT * FROM g WHERE p = -1)
      SELECT o.cell_key, any_value(o.n) AS weeks, R6(any_value(o.sg)) AS signed_gap, R6(any_value(o.ag)) AS abs_gap,
             CAST(coalesce(sum(g.times) FILTER (abs(g.sg) >= abs(o.sg) - 1e-12), 0) AS BIGINT) AS count_signed, CAST(coalesce(sum(g.times) FILTER (g.ag >= o.ag - 1e-12), 0) AS BIGINT) AS count_abs,
             R6((count_signed + 1) / ({WEEK_DEALS} + 1)::DOUBLE) AS p_signed, R6((count_abs + 1) / ({WEEK_DEALS} + 1)::DOUBLE) AS p_abs, R6(round(sum(g.ag * g.times) / {WEEK_DEALS}, 9)) AS null_abs_gap
      FROM o JOIN g ON g.cell_key = o.cell_key AND g.p >= 0 GROUP BY 1""",
)
def year_shuffle_test(db):
    rows = shuffles.week_shuffle_test(db.cell_day.where("tier = 'archive'"), "tmax_C", EARLY, LATE, deals=WEEK_DEALS)
    return rows.select(
        "cell_key", F.col("groups").alias("weeks"), r6(F.col("signed_gap")).alias("signed_gap"), r6(F.col("abs_gap")).alias("abs_gap"), "count_signed", "count_abs",
        r6(F.col("p_signed")).alias("p_signed"), r6(F.col("p_abs")).alias("p_abs"),
        # a tie at the sixth decimal must not hang on the order of a sum
        r6(F.round("null_abs_gap", 9)).alias("null_abs_gap"),
    )


BLOCK_SQL = f"""WITH s AS MATERIALIZED (SELECT cell_key, CAST(year(date) AS INT) AS y, tmax_C AS v FROM cell_day WHERE tier <> 'forecast' AND {SEASON_SQL} AND year(date) BETWEEN 1995 AND 2000), {dealt_sql(BLOCK_DEALS)},
      g AS (SELECT p, cell_key, any_value(times) AS times, quantile_cont(CASE WHEN NOT early THEN v END, 0.5) - quantile_cont(CASE WHEN early THEN v END, 0.5) AS diff FROM s JOIN a ON s.y = a.y GROUP BY 1, 2),
      o AS (SELECT * FROM g WHERE p = -1),
      r AS (SELECT o.cell_key, any_value(o.diff) AS diff, (coalesce(sum(g.times) FILTER (abs(g.diff) >= abs(o.diff) - 1e-12), 0) + 1) / ({BLOCK_DEALS} + 1)::DOUBLE AS p FROM o JOIN g ON g.cell_key = o.cell_key AND g.p >= 0 GROUP BY 1)"""


def block_test(db):
    pool = in_window(db).where("tier <> 'forecast'")
    return shuffles.year_block_test(pool, "tmax_C", EARLY, LATE, deals=BLOCK_DEALS)


@query("year_block_test", f"{BLOCK_SQL} SELECT cell_key, R6(diff) AS observed_diff, R6(p) AS p FROM r")
def year_block_test(db):
    return block_test(db).select("cell_key", r6(F.col("observed_diff")).alias("observed_diff"), r6(F.col("p")).alias("p"))


@query(
    "significance_tier",
    f"""{BLOCK_SQL} SELECT cell_key, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS tier,
        CASE WHEN p < 0.05 THEN CASE WHEN diff >= 0 THEN 'up' ELSE 'down' END END AS direction FROM r""",
)
def significance_tier(db):
    tier, direction = shuffles.significance(F.col("p"), F.col("observed_diff"))
    return block_test(db).select("cell_key", tier.alias("tier"), direction.alias("direction"))


# ---- tiers and claims ----------------------------------------------------------------

POOL_SQL = """t AS MATERIALIZED (SELECT * FROM banded),
   h AS MATERIALIZED (SELECT cell_key, date, truth AS v FROM banded),
   b AS (SELECT t.cell_key, t.date, list_sort(list(h.v)) AS a FROM t JOIN h ON h.cell_key = t.cell_key AND h.date < t.date GROUP BY 1, 2),
   w AS (SELECT t.cell_key, t.date, list_sort(list(h.v)) AS s FROM t JOIN h ON h.cell_key = t.cell_key AND h.date < t.date
         AND h.date BETWEEN make_date(year(h.date), month(t.date), 1) + CAST(day(t.date) - 1 AS INT) - 3 AND make_date(year(h.date), month(t.date), 1) + CAST(day(t.date) - 1 AS INT) + 3 GROUP BY 1, 2),
   k AS (SELECT t.*, s, a, CAST(len(s) AS INT) AS n, CAST(len(a) AS INT) AS na, len(list_filter(s, lambda v: v >= t.mid)) AS rh, len(list_filter(s, lambda v: v <= t.mid)) AS rl,
                len(list_filter(a, lambda v: v >= t.mid)) AS ah, len(list_filter(a, lambda v: v <= t.mid)) AS al FROM t JOIN b ON b.cell_key = t.cell_key AND b.date = t.date JOIN w ON w.cell_key = t.cell_key AND w.date = t.date),
   z AS (SELECT *, rh <= rl AS high, CASE WHEN rh <= rl THEN rh ELSE rl END / n::DOUBLE AS tail, CASE WHEN rh <= rl THEN ah ELSE al END AS atr FROM k),
   m AS MATERIALIZED (SELECT *, CASE WHEN atr BETWEEN 1 AND 10 THEN 'alltime' WHEN tail <= 0.05 THEN 'extreme' WHEN tail <= 0.1 THEN 'mid' WHEN tail <= 0.2 THEN 'notable'
                WHEN rl / n::DOUBLE BETWEEN 0.4 AND 0.6 THEN 'mildDead' ELSE 'mildOff' END AS tier FROM z),
   c AS MATERIALIZED (SELECT *, CASE tier WHEN 'alltime' THEN 10.0::DOUBLE / greatest(1, na) WHEN 'extreme' THEN 0.05::DOUBLE WHEN 'mid' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS cut FROM m)"""


def _cut(lst, n, share, high):
    idx = f"floor((1.0::DOUBLE - {share}) * {n})" if high else f"ceil({share} * {n}) - 1"
    return f"{lst}[greatest(0, least({n} - 1, CAST({idx} AS INT))) + 1]"


def side_cut(lst, n, share):
    return f"(CASE WHEN high THEN {_cut(lst, n, share, True)} ELSE {_cut(lst, n, share, False)} END)"


def eval_pools(db):
    """Every day of the banded pairs with what came before it."""
    # stored: the days are read twice, as targets and as history
    banded = materialize(db.banded, "banded")
    return pools.history_pools(banded, banded, "truth", carried=[c for c in banded.columns if c not in ("cell_key", "date")])


@query(
    "forecast_tier",
    f"""WITH {POOL_SQL} SELECT cell_key, date, tier, high AS high_side, R6(tail) AS single_tail, R6(cut) AS cutoff, tier LIKE 'mild%' AS two_sided,
        R6(CASE tier WHEN 'alltime' THEN {side_cut('a', 'na', 'cut')} WHEN 'mildDead' THEN (s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2 WHEN 'mildOff' THEN {side_cut('s', 'n', '0.3::DOUBLE')} ELSE {side_cut('s', 'n', 'cut')} END) AS reference FROM c""",
)
def forecast_tier(db):
    rows = pools.resolve_tier(eval_pools(db), F.col("mid"), bucketed=True).where("n_win > 0")
    return rows.select("cell_key", "date", "tier", "high_side", r6(F.col("single_tail")).alias("single_tail"), r6(F.col("cutoff")).alias("cutoff"), "two_sided", r6(F.col("reference")).alias("reference"))


def prob_sql(heads, lo, hi):
    """The nine-point interval probability as SQL."""
    parts = [f"CASE WHEN {lo} <= {heads[0]} AND {heads[0]} <= {hi} THEN {LEVELS[0]} ELSE 0 END", f"CASE WHEN {lo} <= {heads[-1]} AND {heads[-1]} <= {hi} THEN {1 - LEVELS[-1]!r} ELSE 0 END"]
    for a, b, p, q in zip(heads, heads[1:], LEVELS, LEVELS[1:]):
        parts.append(f"CASE WHEN {b} = {a} THEN CASE WHEN {lo} <= {a} AND {a} <= {hi} THEN {q - p!r}::DOUBLE ELSE 0 END ELSE {q - p!r}::DOUBLE * ((least(greatest({hi}, {a}), {b}) - least(greatest({lo}, {a}), {b})) / ({b} - {a})) END")
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {' + '.join(f'({x})' for x in parts)}))"


INF = "'infinity'::DOUBLE"
CLAIM_SQL = f"""{POOL_SQL}, e AS MATERIALIZED (SELECT *, {_cut('s', 'n', 'cut', False)} AS lo_t, {_cut('s', 'n', 'cut', True)} AS hi_t,
     CASE WHEN tier = 'alltime' THEN {side_cut('a', 'na', 'cut')} ELSE {side_cut('s', 'n', 'cut')} END AS one_t FROM c),
   f AS MATERIALIZED (SELECT *, CASE WHEN tier LIKE 'mild%' THEN {prob_sql(BAND_COLUMNS, 'lo_t', 'hi_t')} WHEN high THEN {prob_sql(BAND_COLUMNS, 'one_t', INF)} ELSE {prob_sql(BAND_COLUMNS, '-' + INF, 'one_t')} END AS chance,
     CASE WHEN tier LIKE 'mild%' THEN lo_t <= truth AND truth <= hi_t WHEN high THEN truth >= one_t ELSE truth <= one_t END AS kept FROM e),
   claims AS MATERIALIZED (SELECT cell_key, date, truth, hres, {', '.join(BAND_COLUMNS)}, tier, round(chance, 6) AS claimed_p, CAST(kept AS INT) AS hit, CAST(least(95, floor(round(chance, 6) * 20 + 0.5) * 5) AS INT) AS displayed FROM f WHERE n >= 5)"""


def claims(db):
    made = pools.card_claims(eval_pools(db), F.col("truth"), F.col("mid"))
    # stored: a filter on the claim would otherwise be inlined, with all its pools, into every plan below
    kept = ["cell_key", "date", "truth", "hres", *BAND_COLUMNS, "tier", "claimed_p", "hit"]
    rows = materialize(made.select(*kept), "claims").where("claimed_p IS NOT NULL")
    chance = F.round("claimed_p", 6)
    shown = F.least(F.lit(95), F.floor(chance * 20 + 0.5) * 5).cast("int")
    return rows.withColumn("claimed_p", chance).withColumn("displayed", shown)


@query("card_claim", f"WITH {CLAIM_SQL} SELECT cell_key, date, tier, R6(claimed_p) AS claimed_p, displayed, hit FROM claims")
def card_claim(db):
    return claims(db).select("cell_key", "date", "tier", r6(F.col("claimed_p")).alias("claimed_p"), "displayed", "hit")


@query("prob_interval", f"SELECT cell_key, date, R6({prob_sql(BAND_COLUMNS, 'hres - 3', 'hres - 1')}) AS inside, R6({prob_sql(BAND_COLUMNS, 'hres - 2', INF)}) AS above FROM banded")
def prob_interval(db):
    points = [F.col(c) for c in BAND_COLUMNS]
    inside = band_fn.prob_interval(points, F.col("hres") - 3, F.col("hres") - 1)
    above = band_fn.prob_beyond(points, F.col("hres") - 2, F.lit(True))
    return db.banded.select("cell_key", "date", r6(inside).alias("inside"), r6(above).alias("above"))


def inverse_sql(u):
    cases = "".join(
        f" WHEN {u} <= {q} THEN {a} + ({u} - {p}::DOUBLE) / {q - p!r}::DOUBLE * ({b} - {a})" for a, b, p, q in zip(BAND_COLUMNS, BAND_COLUMNS[1:], LEVELS, LEVELS[1:])
    )
    return f"CASE WHEN {u} <= {LEVELS[0]} THEN {BAND_COLUMNS[0]}{cases} ELSE {BAND_COLUMNS[-1]} END"


@query("inv_cdf", f"SELECT cell_key, date, R6({inverse_sql('0.15::DOUBLE')}) AS u15, R6({inverse_sql('0.6::DOUBLE')}) AS u60, R6({inverse_sql('0.995::DOUBLE')}) AS u995 FROM banded")
def inv_cdf(db):
    points = [F.col(c) for c in BAND_COLUMNS]
    return db.banded.select("cell_key", "date", *[r6(band_fn.inverse_cdf(points, F.lit(u))).alias(n) for n, u in (("u15", 0.15), ("u60", 0.6), ("u995", 0.995))])


@query(
    "band_tail_range",
    f"""WITH {POOL_SQL}, x AS (SELECT *, CASE WHEN high THEN len(list_filter(s, lambda v: v >= lo)) ELSE len(list_filter(s, lambda v: v <= lo)) END * 100.0::DOUBLE / n AS p, CASE WHEN high THEN len(list_filter(s, lambda v: v >= hi)) ELSE len(list_filter(s, lambda v: v <= hi)) END * 100.0::DOUBLE / n AS q FROM c)
      SELECT cell_key, date, R6(CASE WHEN greatest(p, q) <= 50 THEN greatest(least(p, q), 100.0::DOUBLE / n) END) AS near_pct, R6(CASE WHEN greatest(p, q) <= 50 THEN greatest(p, q) END) AS far_pct FROM x""",
)
def band_tail_range(db):
    rows = pools.resolve_tier(eval_pools(db), F.col("mid"), bucketed=True).where("n_win > 0")
    ends = pools.band_tail_range(rows, F.col("lo"), F.col("hi"), F.col("high_side"))
    return ends.select("cell_key", "date", r6(F.col("near_pct")).alias("near_pct"), r6(F.col("far_pct")).alias("far_pct"))


@query(
    "day_rank",
    f"""SELECT r.cell_key, rank_high, rank_low, total, y.year, R6(y.p50) AS p50 FROM {RANK_SQL} r JOIN {YEARLY_SQL} y ON r.cell_key = y.cell_key""",
)
def day_rank(db):
    """The flagship: how the target day ranks in its season, with the yearly medians."""
    years = clim.yearly_bands(season_pool(db), "tmax_C")
    return ranks(db).join(years, "cell_key").select("cell_key", "rank_high", "rank_low", "total", "year", r6(F.col("p50")).alias("p50"))
