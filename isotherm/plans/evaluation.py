"""Pair-frame windows, calibration, baking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions import calendar, derive
from isotherm.functions.rounding import r6
from isotherm.operators import calibrate, cells, models, pairs
from isotherm.operators import evaluate as ev
from isotherm.operators.order_stats import weighted_quantiles
from isotherm.plans.climatology import CLAIM_SQL, claims, inverse_sql
from isotherm.plans.joins import EDGES_SQL, QM_SQL
from isotherm.plans.registry import query
from isotherm.schemas import BAND_COLUMNS, DELTA_COLUMNS, LEVELS
from isotherm.session import materialize

LEVEL_LIST = "[" + ", ".join(str(p) for p in LEVELS) + "]"


def out(df, keys, values):
    """Keys as they are, values to six decimals."""
    return df.select(*keys, *[r6(F.col(v)).alias(v) for v in values])


# ---- windows of the pair frame ---------------------------------------------------------


@query("pct_rank_avg", "SELECT cell_key, date, R6(u) AS u, R6(f) AS f FROM labelled")
def pct_rank_avg(db):
    return out(pairs.tail_labels(db.pairs), ["cell_key", "date"], ["u", "f"])


@query("block_split", "SELECT cell_key, date, block, role FROM split_pairs")
def block_split(db):
    return pairs.blocked_split(db.pairs).select("cell_key", "date", "block", "role")


@query(
    "split_pivot",
    """SELECT season, count_if(role = 'train') AS train, count_if(role = 'val') AS val, count_if(role = 'test') AS test, count_if(role = 'embargo') AS embargo FROM labelled GROUP BY 1""",
)
def split_pivot(db):
    return db.roles.groupBy("season").pivot("role", ["train", "val", "test", "embargo"]).count().fillna(0)


@query(
    "calib_eval_halves",
    """SELECT cell_key, date, CASE WHEN (dense_rank() OVER (ORDER BY block) - 1) % 2 = 0 THEN 'calib' ELSE 'eval' END AS half, CASE WHEN day(date) % 2 = 1 THEN 'odd' ELSE 'even' END AS day_half
       FROM labelled WHERE role = 'test'""",
)
def calib_eval_halves(db):
    return pairs.calibration_halves(db.roles).select("cell_key", "date", "half", pairs.day_halves(F.col("date")).alias("day_half"))


FORECAST_PCT = """(SELECT t.*, (SELECT count(*) FROM labelled r WHERE r.role = 'train' AND r.cell_key = t.cell_key AND r.hres <= t.hres) / (SELECT count(*) FROM labelled r WHERE r.role = 'train' AND r.cell_key = t.cell_key)::DOUBLE AS pct
   FROM labelled t WHERE t.role = 'test')"""


@query(
    "forecast_pct",
    f"""SELECT cell_key, date, R6(pct) AS forecast_pct, CASE WHEN pct <= 0.01 THEN 'bottom 1%' WHEN pct <= 0.05 THEN '1-5%' WHEN pct <= 0.25 THEN '5-25%' WHEN pct <= 0.75 THEN '25-75%'
        WHEN pct <= 0.95 THEN '75-95%' WHEN pct <= 0.99 THEN '95-99%' ELSE 'top 1%' END AS bin FROM {FORECAST_PCT}""",
)
def forecast_pct(db):
    rows = pairs.forecast_share(db.roles.where("role = 'train'"), db.roles.where("role = 'test'"))
    return rows.select("cell_key", "date", r6(F.col("forecast_pct")).alias("forecast_pct"), pairs.forecast_bin(F.col("forecast_pct")).alias("bin"))


@query(
    "group_transform",
    """SELECT cell_key, date, R6(era5 - hres - avg(era5 - hres) OVER (PARTITION BY cell_key)) AS anomaly, era5 >= quantile_cont(era5, 0.95) OVER (PARTITION BY cell_key) AS in_tail FROM pairs""",
)
def group_transform(db):
    rows = ev.tail_days(ev.remove_cell_mean(pairs.with_bias(db.pairs), "bias"), "era5", 0.05, high=True)
    return rows.select("cell_key", "date", r6(F.col("anomaly")).alias("anomaly"), "in_tail")


@query(
    "stratified_sample",
    """WITH r AS (SELECT cell_id, lat, row_number() OVER (ORDER BY lat, cell_id) - 1 AS i, count(*) OVER () AS n FROM cells)
      SELECT cell_id, lat FROM r WHERE i IN (SELECT CAST(round_even(range * (((SELECT count(*) FROM cells) - 1) / 39.0::DOUBLE), 0) AS BIGINT) FROM range(0, 40))""",
)
def stratified_sample(db):
    return cells.stratified_sample(db.cells, 40, key="cell_id").select("cell_id", "lat")


@query(
    "share_of_total",
    """WITH c AS (SELECT cell_key, count_if(abs(era5 - hres) > 3) AS big FROM pairs GROUP BY 1)
      SELECT cell_key, big, R6(big / sum(big) OVER ()) AS share, R6(sum(big) OVER (ORDER BY big DESC, cell_key) / sum(big) OVER ()) AS running FROM c""",
)
def share_of_total(db):
    counts = db.pairs.groupBy("cell_key").agg(F.count_if(F.abs(F.col("era5") - F.col("hres")) > 3).alias("big"))
    rows = ev.share_of_total(counts, "big", [F.col("big").desc(), F.col("cell_key")])
    return out(rows, ["cell_key", "big"], ["share", "running"])


# ---- error studies ---------------------------------------------------------------------


def studied(db):
    """Long pairs with their error and the cell's geography."""
    rows = pairs.attach_static(db.pairs_long, db.static).withColumn("diff", F.col("hres") - F.col("archive"))
    return rows.withColumns(
        {
            "zone": derive.climate_zone(F.col("lat")),
            "elev_band": derive.elevation_band(F.col("elevation")),
            "season": calendar.local_season(F.col("date"), F.col("lat")),
        }
    )


STUDY_SQL = """(SELECT p.*, hres - archive AS diff, s.lat, s.elevation, s.elevation - s.hres_elevation AS elev_diff_m, log10(greatest(population, 1)) AS pop_log,
     CASE WHEN abs(lat) <= 23.5 THEN 'Tropical' WHEN abs(lat) <= 35 THEN 'Subtropical' WHEN abs(lat) <= 55 THEN 'Mid-latitude' ELSE 'High-latitude' END AS zone,
     CASE WHEN elevation <= 200 THEN 'Lowland' WHEN elevation <= 1000 THEN 'Upland' WHEN elevation <= 2500 THEN 'Highland' ELSE 'Mountain' END AS elev_band,
     CASE (CASE WHEN lat >= 0 THEN month(date) ELSE (month(date) + 5) % 12 + 1 END) % 12 // 3 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Autumn' END AS season
   FROM pairs_long p JOIN static s ON p.cell_key = s.cell_key)"""
SUMMARY_SQL = """R6(avg(diff)) AS mean, R6(stddev_samp(diff)) AS std, R6(avg(abs(diff))) AS mae, R6(sqrt(avg(diff * diff))) AS rmse, count(*) AS n,
   R6(quantile_cont(diff, 0.05)) AS p05, R6(quantile_cont(diff, 0.5)) AS median, R6(quantile_cont(diff, 0.95)) AS p95"""
SUMMARY = ["mean", "std", "mae", "rmse", "p05", "median", "p95"]


@query("error_summary", f"SELECT metric, {SUMMARY_SQL} FROM {STUDY_SQL} GROUP BY 1")
def error_summary(db):
    return out(ev.error_summary(studied(db), ["metric"], "diff"), ["metric", "n"], SUMMARY)


@query(
    "bias_rollups",
    " UNION ALL ".join(f"SELECT metric, '{c}' AS cut, {c} AS \"group\", {SUMMARY_SQL} FROM {STUDY_SQL} GROUP BY 1, 2, 3" for c in ("cell_key", "zone", "elev_band", "season")),
)
def bias_rollups(db):
    rows = ev.bias_rollups(studied(db), "diff", ["cell_key", "zone", "elev_band", "season"])
    return out(rows, ["metric", "cut", "group", "n"], SUMMARY)


@query(
    "systematic_share",
    f"""SELECT zone, R6(abs(avg(diff) FILTER (metric = 'tmax')) / sqrt(avg(diff * diff) FILTER (metric = 'tmax'))) AS tmax, R6(abs(avg(diff) FILTER (metric = 'precip')) / sqrt(avg(diff * diff) FILTER (metric = 'precip'))) AS precip,
        R6(abs(avg(diff) FILTER (metric = 'wind')) / sqrt(avg(diff * diff) FILTER (metric = 'wind'))) AS wind FROM {STUDY_SQL} GROUP BY 1""",
)
def systematic_share(db):
    return out(ev.systematic_share(studied(db), "diff", "zone", ["tmax", "precip", "wind"]), ["zone"], ["tmax", "precip", "wind"])


@query(
    "intensity_ratio",
    """WITH a AS (SELECT cell_key, avg(hres) / avg(archive) AS mr, quantile_cont(hres, [0.5, 0.75, 0.95]) AS r, quantile_cont(archive, [0.5, 0.75, 0.95]) AS l FROM pairs_long WHERE metric = 'wind' GROUP BY 1)
      SELECT cell_key, R6(mr) AS mean_ratio, [0.5, 0.75, 0.95][i]::DOUBLE AS level, R6(r[i] / l[i]) AS ratio FROM a, (SELECT CAST(range AS INT) AS i FROM range(1, 4))""",
)
def intensity_ratio(db):
    rows = ev.intensity_ratio(db.pairs_long.where("metric = 'wind'"), "archive", "hres", [0.5, 0.75, 0.95])
    return out(rows, ["cell_key", "level"], ["mean_ratio", "ratio"])


@query(
    "wet_frequency",
    """SELECT cell_key, R6(100.0 * avg(CAST(era5_precip < 0.1 AS INT))) AS dry_truth, R6(100.0 * avg(CAST(era5_precip >= 1 AS INT))) AS wet_truth, R6(quantile_cont(era5_precip, 0.99)) AS p99_truth,
              R6(100.0 * avg(CAST(hres_precip < 0.1 AS INT))) AS dry_forecast, R6(100.0 * avg(CAST(hres_precip >= 1 AS INT))) AS wet_forecast, R6(quantile_cont(hres_precip, 0.99)) AS p99_forecast FROM pairs_wide GROUP BY 1""",
)
def wet_frequency(db):
    rows = ev.wet_frequency(db.pairs_wide, "era5_precip", "hres_precip")
    return out(rows, ["cell_key"], [c for c in rows.columns if c != "cell_key"])


@query(
    "headline_shift",
    """WITH x AS (SELECT metric, cell_key, round(quantile_cont(hres, 0.9), 9) AS x FROM pairs_long GROUP BY 1, 2),
      g AS (SELECT p.metric, p.cell_key, 100.0 * avg(CAST(round(hres, 9) < x AS INT)) - 100.0 * avg(CAST(round(archive, 9) < x AS INT)) AS gap FROM pairs_long p JOIN x ON p.metric = x.metric AND p.cell_key = x.cell_key GROUP BY 1, 2)
      SELECT metric, R6(avg(gap)) AS mean_gap, R6(min(gap)) AS min_gap, R6(max(gap)) AS max_gap FROM g GROUP BY 1""",
)
def headline_shift(db):
    return out(ev.headline_shift(db.pairs_long, "archive", "hres"), ["metric"], ["mean_gap", "min_gap", "max_gap"])


@query(
    "conditional_bias",
    f"""WITH e AS (SELECT metric, list_distinct(quantile_cont(archive, [{', '.join(str(i / 20) for i in range(21))}])) AS e0 FROM {STUDY_SQL} GROUP BY 1), s AS (SELECT metric, list_sort(e0) AS edges FROM e),
      b AS (SELECT t.metric, diff, len(list_filter(edges, lambda x: x < archive)) - 1 AS bin FROM {STUDY_SQL} t JOIN s ON t.metric = s.metric)
      SELECT metric, bin, R6(avg(diff)) AS mean, count(*) AS days, R6(quantile_cont(diff, 0.25)) AS q25, R6(quantile_cont(diff, 0.75)) AS q75 FROM b WHERE bin >= 0 GROUP BY 1, 2""",
)
def conditional_bias(db):
    return out(ev.conditional_bias(studied(db), ["metric"], "archive", "diff"), ["metric", "bin", "days"], ["mean", "q25", "q75"])


@query(
    "regression_cut",
    f"""WITH c AS (SELECT metric, cell_key, avg(diff) AS d, any_value(elev_diff_m) AS e FROM {STUDY_SQL} GROUP BY 1, 2),
      k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY d) AS rd, rank() OVER (PARTITION BY metric ORDER BY e) AS re FROM c)
      SELECT metric, R6(regr_slope(d, e)) AS slope, R6(regr_intercept(d, e)) AS intercept, R6(corr(d, e)) AS r, R6(corr(rd, re)) AS rho, count(*) AS cells FROM k GROUP BY 1""",
)
def regression_cut(db):
    by_cell = studied(db).groupBy("metric", "cell_key").agg(F.avg("diff").alias("d"), F.first("elev_diff_m").alias("e"))
    rows = ev.regression_cut(by_cell, ["metric"], "d", "e").join(ev.spearman(by_cell, ["metric"], "d", "e"), "metric")
    return out(rows, ["metric", "cells"], ["slope", "intercept", "r", "rho"])


@query(
    "concentration",
    """WITH c AS (SELECT cell_key, count_if(abs(hres - era5) > 3) AS big_days, avg(CAST(abs(hres - era5) > 3 AS INT)) AS rate FROM pairs GROUP BY 1)
      SELECT cell_key, big_days, R6(rate) AS rate, row_number() OVER (ORDER BY big_days DESC, cell_key) AS rank, R6(sum(big_days) OVER (ORDER BY big_days DESC, cell_key) / sum(big_days) OVER ()) AS cum_share FROM c""",
)
def concentration(db):
    rows = ev.concentration(db.pairs, F.abs(F.col("hres") - F.col("era5")) > derive.BIG_MISS)
    return out(rows, ["cell_key", "big_days", "rank"], ["rate", "cum_share"])


@query(
    "fixable_share",
    f"""WITH t AS (SELECT *, diff - 0.0065::DOUBLE * elev_diff_m AS lapse, diff - avg(diff) OVER (PARTITION BY metric, cell_key) AS anom FROM {STUDY_SQL}),
      c AS (SELECT metric, cell_key, avg(diff) AS b, any_value(elev_diff_m) AS e FROM {STUDY_SQL} GROUP BY 1, 2), r AS (SELECT metric, corr(b, e) AS r FROM c GROUP BY 1)
      SELECT t.metric, R6(100.0 * avg(CAST(abs(diff) > 3 AS INT))) AS raw_pct, R6(100.0 * avg(CAST(abs(lapse) > 3 AS INT))) AS lapse_pct, R6(100.0 * avg(CAST(abs(anom) > 3 AS INT))) AS cell_pct, R6(avg(abs(diff))) AS raw_mae,
             R6(avg(abs(lapse))) AS lapse_mae, R6(any_value(r)) AS r_bias_elev FROM t JOIN r ON t.metric = r.metric GROUP BY 1""",
)
def fixable_share(db):
    rows = ev.fixable_share(studied(db), "diff", "elev_diff_m")
    return out(rows, ["metric"], [c for c in rows.columns if c != "metric"])


QQ_LEVELS = [0.005, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995]
_QQ = "[" + ", ".join(str(q) for q in QQ_LEVELS) + "]"


@query(
    "qq_points",
    f"""WITH a AS (SELECT metric, quantile_cont(archive, {_QQ}) AS a, quantile_cont(hres, {_QQ}) AS b FROM pairs_long GROUP BY 1)
      SELECT metric, {_QQ}[i]::DOUBLE AS level, R6(a[i]) AS archive, R6(b[i]) AS hres FROM a, (SELECT CAST(range AS INT) AS i FROM range(1, {len(QQ_LEVELS) + 1}))""",
)
def qq_points(db):
    return out(ev.qq_points(db.pairs_long, ["metric"], "archive", "hres", QQ_LEVELS), ["metric", "level"], ["archive", "hres"])


@query(
    "qq_gap",
    f"""WITH a AS (SELECT metric, cell_key, quantile_cont(archive, {_QQ}) AS a, quantile_cont(hres, {_QQ}) AS b FROM pairs_long GROUP BY 1, 2),
      g AS (SELECT metric, cell_key, list_avg(list_transform(range(1, {len(QQ_LEVELS) + 1}), lambda i: abs(a[i] - b[i]))) AS gap FROM a)
      SELECT metric, R6(avg(gap)) AS mean_gap, R6(max(gap)) AS worst_gap FROM g GROUP BY 1""",
)
def qq_gap(db):
    gaps = ev.qq_gap(db.pairs_long, "archive", "hres", QQ_LEVELS, ["metric", "cell_key"])
    return out(gaps.groupBy("metric").agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("worst_gap")), ["metric"], ["mean_gap", "worst_gap"])


# ---- scoring of corrections --------------------------------------------------------------


def scored(db):
    """Test days with three predictions: raw, the cell's median correction, the mapped value."""
    train = db.roles.where("role = 'train'")
    medians = train.groupBy("cell_key").agg(F.percentile("bias", F.lit(0.5)).alias("_m"))
    mapped = calibrate.quantile_map(train, db.roles.where("role = 'test'")).join(medians, "cell_key")
    return mapped.select(
        "cell_key", "date", "season", "fc_version", "dec", "dec1", F.col("era5").alias("truth"), F.col("hres").alias("raw"), (F.col("hres") + F.col("_m")).alias("corrected"), "mapped"
    )


SCORED = f"""(SELECT t.cell_key, date, season, fc_version, dec, dec1, era5 AS truth, hres AS raw, hres + m.mb AS corrected, mapped FROM {QM_SQL} t
   JOIN (SELECT cell_key, quantile_cont(bias, 0.5) AS mb FROM labelled WHERE role = 'train' GROUP BY 1) m ON t.cell_key = m.cell_key)"""
MODELS = ["raw", "corrected", "mapped"]
BIG = 3.0


def _score_sql(m, keys):
    e = f"abs(truth - {m})"
    tail = f"0.5 * (avg({e}) FILTER (dec = 'low') + avg({e}) FILTER (dec = 'high'))"
    tail1 = f"0.5 * (avg({e}) FILTER (dec1 = 'p01') + avg({e}) FILTER (dec1 = 'p99'))"
    raw = {k: v.replace(m, "raw") for k, v in (("mae", f"avg({e})"), ("tail", tail), ("tail1", tail1))}
    return f"""SELECT {keys}, '{m}' AS model, count(*) AS n, R6(avg({e})) AS mae, R6({tail}) AS tail, R6({tail1}) AS tail1, count_if({e} >= {BIG}) AS big,
       R6(100 * (1 - avg({e}) / {raw['mae']})) AS gain, R6(100 * (1 - ({tail}) / ({raw['tail']}))) AS tail_gain, R6(100 * (1 - ({tail1}) / ({raw['tail1']}))) AS tail1_gain FROM s GROUP BY ALL"""


@query("point_scores", f"WITH s AS MATERIALIZED (SELECT * FROM {SCORED}) " + " UNION ALL ".join(_score_sql(m, "season") for m in MODELS))
def point_scores(db):
    rows = ev.point_scores(scored(db), ["season"], "truth", MODELS, "raw", BIG)
    return out(rows, ["season", "model", "n", "big"], ["mae", "tail", "tail1", "gain", "tail_gain", "tail1_gain"])


@query(
    "score_winners",
    f"""WITH s AS MATERIALIZED (SELECT * FROM {SCORED}), a AS (SELECT fc_version, cell_key, avg(abs(truth - corrected)) AS c, avg(abs(truth - mapped)) AS m FROM s GROUP BY 1, 2)
      SELECT fc_version, cell_key, CASE WHEN c <= m THEN 'corrected' ELSE 'mapped' END AS winner FROM a""",
)
def score_winners(db):
    rows = ev.point_scores(scored(db), ["fc_version", "cell_key"], "truth", ["corrected", "mapped"], "corrected", BIG)
    return ev.winners(rows, ["fc_version", "cell_key"])


@query(
    "error_tail_percentiles",
    f"WITH s AS MATERIALIZED (SELECT * FROM {SCORED}) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, R6(quantile_cont(abs(truth - {m}), 0.5)) AS p50, R6(quantile_cont(abs(truth - {m}), 0.9)) AS p90, R6(quantile_cont(abs(truth - {m}), 0.99)) AS p99, R6(quantile_cont(abs(truth - {m}), 0.999)) AS p999, R6(max(abs(truth - {m}))) AS worst FROM s"
        for m in MODELS
    ),
)
def error_tail_percentiles(db):
    return out(ev.error_tail_percentiles(scored(db), "truth", MODELS), ["model"], ["p50", "p90", "p99", "p999", "worst"])


PER_CELL = f"""(SELECT cell_key, count(*) AS n, avg(abs(truth - raw)) AS mae_raw, avg(abs(truth - corrected)) AS mae_corrected, quantile_cont(abs(truth - raw), 0.95) AS p95_raw, quantile_cont(abs(truth - corrected), 0.95) AS p95_corrected
   FROM {SCORED} GROUP BY 1 HAVING count(*) >= 30)"""
CELL_SCORES = ["mae_raw", "mae_corrected", "p95_raw", "p95_corrected"]


@query("per_cell_scores", f"SELECT cell_key, n, {', '.join(f'R6({c}) AS {c}' for c in CELL_SCORES)} FROM {PER_CELL}")
def per_cell_scores(db):
    return out(ev.per_cell_scores(scored(db), "truth", "raw", "corrected", 30), ["cell_key", "n"], CELL_SCORES)


@query("worst_cells", f"SELECT p.cell_key, s.name, R6(mae_corrected) AS mae_corrected FROM {PER_CELL} p JOIN static s ON p.cell_key = s.cell_key ORDER BY p.mae_corrected DESC LIMIT 3")
def worst_cells(db):
    worst = ev.per_cell_scores(scored(db), "truth", "raw", "corrected", 30).orderBy(F.col("mae_corrected").desc(), "cell_key").limit(3)
    return worst.join(db.static, "cell_key").select("cell_key", "name", r6(F.col("mae_corrected")).alias("mae_corrected"))


@query("gate_cells", f"SELECT cell_key, R6(mae_corrected - mae_raw) AS damage FROM {PER_CELL} WHERE mae_corrected - mae_raw > -2.4")
def gate_cells(db):
    scores = ev.per_cell_scores(scored(db), "truth", "raw", "corrected", 30)
    gated = calibrate.gated_cells(scores, limit=-2.4)
    return gated.select("cell_key", r6(F.col("mae_corrected") - F.col("mae_raw")).alias("damage"))


def _wilson_half(p, n):
    return f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 1.96::DOUBLE * 1.96 / (4 * {n} * {n})) / (1 + 1.96::DOUBLE * 1.96 / {n})"


BANDED_LABELLED = "(SELECT b.*, l.dec, l.dec1, l.fdec, l.season, l.fc_version, l.role, l.block FROM banded b JOIN labelled l ON b.cell_key = l.cell_key AND b.date = l.date)"


def banded_labelled(db):
    labels = db.roles.select("cell_key", "date", "dec", "dec1", "fdec", "season", "fc_version", "role", "block", "bias")
    return db.banded.join(labels, ["cell_key", "date"])


@query(
    "band_coverage",
    f"""WITH c AS (SELECT cell_key, avg(CAST(truth BETWEEN lo AND hi AS INT)) AS coverage, avg(hi - lo) AS width, count(*) AS n, avg(CAST(truth BETWEEN lo AND hi AS INT)) FILTER (dec <> 'mid') AS tail_coverage FROM {BANDED_LABELLED} GROUP BY 1)
      SELECT cell_key, n, R6(coverage) AS coverage, R6(width) AS width, R6(tail_coverage) AS tail_coverage, R6(100 * (coverage - 0.9)) AS error_pp, R6(100 * {_wilson_half('coverage', 'n')}) AS half_pp FROM c""",
)
def band_coverage(db):
    rows = ev.band_coverage(banded_labelled(db), ["cell_key"], "truth", "lo", "hi", 0.9, tails="dec")
    return out(rows, ["cell_key", "n"], ["coverage", "width", "tail_coverage", "error_pp", "half_pp"])




def wobbled(db):
    """Bands whose upper neighbours sag a little on some days, so heads may cross."""
    sag = 0.01 * (F.dayofmonth("date") % 3)
    return db.banded.select("cell_key", "date", "truth", "hres", *[(F.col(c) - sag * i).alias(c) for i, c in enumerate(BAND_COLUMNS)])


@query("crossing_rate", f"SELECT cell_key, count(*) AS n, R6(100.0 * avg(CAST({' OR '.join(f'{b} - 0.01::DOUBLE * (day(date) % 3) * {i + 1} < {a} - 0.01::DOUBLE * (day(date) % 3) * {i}' for i, (a, b) in enumerate(zip(BAND_COLUMNS, BAND_COLUMNS[1:])))} AS INT))) AS crossing_pct FROM banded GROUP BY 1")
def crossing_rate(db):
    return out(ev.crossing_rate(wobbled(db), BAND_COLUMNS, ["cell_key"]), ["cell_key", "n"], ["crossing_pct"])


# ---- calibration -------------------------------------------------------------------------

SIDED = [p for p in LEVELS if p != 0.5]


def _rank(p, n="n"):
    return f"CAST({'least(ceil((' + n + f' + 1) * {p}::DOUBLE), ' + n + ')' if p > 0.5 else 'greatest(floor((' + n + f' + 1) * {p}::DOUBLE), 1)'} AS INT)"


def _shift_union(source, keys, residual, head=None):
    """Conformal shifts of every sided level as SQL; ``head`` maps a level to its column."""
    group = ", ".join(keys)
    parts = []
    for p in SIDED:
        r = f"truth - {head[p]}" if head else residual
        select = f"{group}, " if group else ""
        parts.append(f"SELECT {select}{p}::DOUBLE AS level, n, s[{_rank(p)}] AS shift FROM (SELECT {select}list_sort(list({r})) AS s, CAST(count(*) AS INT) AS n FROM {source} {'GROUP BY ' + group if group else ''})")
    return " UNION ALL ".join(parts)


HEAD = dict(zip(LEVELS, BAND_COLUMNS))
TEST_BANDS = f"(SELECT * FROM {BANDED_LABELLED} WHERE role = 'test')"


def test_bands(db):
    return banded_labelled(db).where("role = 'test'")


@query("conformal_shift", f"SELECT level, n, R6(shift) AS shift FROM ({_shift_union(TEST_BANDS, [], None, HEAD)})")
def conformal_shift(db):
    return out(calibrate.head_shifts(test_bands(db), BAND_COLUMNS, "truth"), ["level", "n"], ["shift"])


FIT_ROWS = "(SELECT * FROM labelled WHERE role IN ('train', 'test'))"


@query("empirical_band", f"SELECT cell_key, level, n, R6(shift) AS shift FROM ({_shift_union(FIT_ROWS, ['cell_key'], 'bias')})")
def empirical_band(db):
    fit = db.roles.where("role IN ('train', 'test')")
    return out(calibrate.conformal_shifts(fit, ["cell_key"], "bias"), ["cell_key", "level", "n"], ["shift"])


WET_BINS = f"(SELECT w.*, era5 - hres AS bias, len(list_filter(edges, lambda e: e <= hres)) AS bin FROM wet_pairs w, {EDGES_SQL})"


def wet_bias(db):
    return db.wet_pairs.withColumn("bias", F.col("era5") - F.col("hres"))


@query("conditional_band", f"SELECT CAST(bin AS INT) AS bin, level, n, R6(shift) AS shift FROM ({_shift_union(WET_BINS, ['bin'], 'bias')})")
def conditional_band(db):
    edges = calibrate.rain_edges(wet_bias(db))
    return out(calibrate.conditional_shifts(wet_bias(db), edges), ["bin", "level", "n"], ["shift"])


@query("symmetric_cqr", f"SELECT n, R6(s[CAST(least(ceil((n + 1) * 0.9::DOUBLE), n) AS INT)]) AS shift FROM (SELECT list_sort(list(greatest(lo - truth, truth - hi))) AS s, CAST(count(*) AS INT) AS n FROM {TEST_BANDS})")
def symmetric_cqr(db):
    return out(calibrate.symmetric_shift(test_bands(db), "lo", "hi", "truth"), ["n"], ["shift"])


_WOB = ", ".join(f"round_even({c} - 0.01::DOUBLE * (day(date) % 3) * {i}, 2) AS {d}" for i, (c, d) in enumerate(zip(BAND_COLUMNS, DELTA_COLUMNS)))
_PIN = ", ".join(
    f"R6({'greatest' if j > 4 else 'least'}({', '.join(DELTA_COLUMNS[4 : j + 1] if j > 4 else DELTA_COLUMNS[j:5])})) AS {d}" if j != 4 else f"R6({d}) AS {d}" for j, d in enumerate(DELTA_COLUMNS)
)


def wobbled_deltas(db):
    return wobbled(db).select("cell_key", "date", *[F.col(c).alias(d) for c, d in zip(BAND_COLUMNS, DELTA_COLUMNS)])


@query("pin_isotonic", f"SELECT cell_key, date, {_PIN} FROM (SELECT cell_key, date, {_WOB} FROM banded)")
def pin_isotonic(db):
    return out(calibrate.pin_heads(wobbled_deltas(db)), ["cell_key", "date"], DELTA_COLUMNS)


_SORTED = ", ".join(f"R6(h[{i + 1}]) AS {d}" for i, d in enumerate(DELTA_COLUMNS))


@query("sort_heads", f"SELECT cell_key, date, {_SORTED} FROM (SELECT cell_key, date, list_sort([{', '.join(f'{c} - 0.01::DOUBLE * (day(date) % 3) * {i}' for i, c in enumerate(BAND_COLUMNS))}]) AS h FROM banded)")
def sort_heads(db):
    return out(calibrate.sort_heads(wobbled_deltas(db)), ["cell_key", "date"], DELTA_COLUMNS)


_LIN = "list_transform(range(0, {k}), lambda i: CASE WHEN i = {m} THEN hi ELSE lo + i * ((hi - lo) / {m}) END)"
_ROUNDED = "list_sort(list_distinct(list_transform({x}, lambda a: round_even(a, 2))))"


@query(
    "anchors",
    f"""WITH t AS (SELECT cell_key, min(hres) AS lo, max(hres) AS hi FROM labelled WHERE role = 'train' GROUP BY 1),
      w AS (SELECT cell_key, min(hres) AS lo, max(hres) AS hi, quantile_cont(hres, [0.0, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 1.0]) AS q FROM wet_pairs GROUP BY 1),
      a AS (SELECT cell_key, 'tmax' AS var, {_ROUNDED.format(x=_LIN.format(k=15, m=14))} AS l FROM t UNION ALL SELECT cell_key, 'precip', {_ROUNDED.format(x='list_concat(q, ' + _LIN.format(k=6, m=5) + ')')} FROM w)
      SELECT cell_key, var, R6(unnest(l)) AS anchor FROM a""",
)
def anchors(db):
    linear = calibrate.value_anchors(db.roles.where("role = 'train'"), "hres", rain=False).withColumn("var", F.lit("tmax"))
    rain = calibrate.value_anchors(db.wet_pairs, "hres", rain=True).withColumn("var", F.lit("precip"))
    return linear.unionByName(rain).select("cell_key", "var", F.explode("anchors").alias("anchor")).withColumn("anchor", r6(F.col("anchor")))


@query(
    "build_grid",
    f"""WITH t AS (SELECT cell_key, min(hres) AS lo, max(hres) AS hi FROM pairs GROUP BY 1), a AS (SELECT cell_key, unnest({_ROUNDED.format(x=_LIN.format(k=15, m=14))}) AS hres FROM t)
      SELECT a.cell_key, R6(hres) AS hres, CAST(1 + 7 * range AS INT) AS doy, elevation FROM a CROSS JOIN range(0, 53) JOIN static s ON s.cell_key = a.cell_key""",
)
def build_grid(db):
    points = calibrate.grid(calibrate.value_anchors(db.pairs, "hres", rain=False)).join(db.static.select("cell_key", "elevation"), "cell_key")
    return points.select("cell_key", r6(F.col("hres")).alias("hres"), "doy", "elevation")


_GATED = ", ".join(
    f"round_even({'0.0::DOUBLE' if p == 0.5 else f'max(shift) FILTER (level = {p})'}, 2) AS {d}" for p, d in zip(LEVELS, DELTA_COLUMNS)
)


@query(
    "gated_table",
    f"""WITH f AS ({_shift_union(FIT_ROWS, ['cell_key'], 'bias')}), r AS (SELECT cell_key, {_GATED} FROM f GROUP BY 1),
      a AS (SELECT cell_key, unnest(list_distinct([round_even(min(hres), 2), round_even(max(hres), 2)])) AS hres FROM labelled WHERE role = 'train' GROUP BY 1)
      SELECT a.cell_key, R6(a.hres) AS hres, doy, {_PIN} FROM a JOIN r ON a.cell_key = r.cell_key, (VALUES (1), (183)) d(doy)""",
)
def gated_table(db):
    fit = db.roles.where("role IN ('train', 'test')")
    shifts = calibrate.as_row(calibrate.conformal_shifts(fit, ["cell_key"], "bias"), ["cell_key"])
    ends = calibrate.end_anchors(db.roles.where("role = 'train'"), "hres")
    return out(calibrate.gated_table(ends, shifts, "tmax"), ["cell_key", "doy"], ["hres", *DELTA_COLUMNS])


# ---- fitted surfaces ---------------------------------------------------------------------

SURFACE_SQL = f"""(WITH ed AS (SELECT cell_key, quantile_cont(hres, [0.2, 0.4, 0.6, 0.8]) AS edges FROM labelled WHERE role = 'train' GROUP BY 1),
    tl AS (SELECT cell_key, concat('t', CAST(substr(cell_key, 2) AS INT) // 2) AS tile_id FROM static),
    b AS MATERIALIZED (SELECT l.cell_key, tile_id, bias, CAST(least(7, floor((dayofyear(date) - 1) * 8 / 366)) AS INT) AS part, CAST(len(list_filter(edges, lambda e: e <= hres)) AS INT) AS bin
          FROM labelled l JOIN ed ON l.cell_key = ed.cell_key JOIN tl ON tl.cell_key = l.cell_key WHERE role = 'train'),
    c AS (SELECT cell_key, part, bin, count(*) AS n, quantile_cont(bias, {LEVEL_LIST}) AS q FROM b GROUP BY 1, 2, 3),
    t AS (SELECT tile_id, part, bin, count(*) AS n, quantile_cont(bias, {LEVEL_LIST}) AS q FROM b GROUP BY 1, 2, 3),
    g AS (SELECT quantile_cont(bias, {LEVEL_LIST}) AS q FROM b)
    SELECT tl.cell_key, edges, p.part, bb.bin, coalesce(c.n, 0) AS n, CASE WHEN c.n >= 40 THEN 'cell' WHEN t.n >= 40 THEN 'tile' ELSE 'global' END AS grain, CASE WHEN c.n >= 40 THEN c.q WHEN t.n >= 40 THEN t.q ELSE g.q END AS q
    FROM tl JOIN ed ON ed.cell_key = tl.cell_key, (SELECT CAST(range AS INT) AS part FROM range(0, 8)) p, (SELECT CAST(range AS INT) AS bin FROM range(0, 5)) bb, g
    LEFT JOIN c ON c.cell_key = tl.cell_key AND c.part = p.part AND c.bin = bb.bin LEFT JOIN t ON t.tile_id = tl.tile_id AND t.part = p.part AND t.bin = bb.bin)"""
_HEADS = ", ".join(f"R6(q[{i + 1}]) AS {d}" for i, d in enumerate(DELTA_COLUMNS))


def surface(db):
    from isotherm.plans.joins import tiled

    fitted = calibrate.fit_surface(db.roles.where("role = 'train'"), tiled(db), min_n=40)
    return materialize(fitted, "surface")


@query("fit_quantile_surface", f"SELECT cell_key, part, bin, n, grain, {_HEADS} FROM {SURFACE_SQL}")
def fit_quantile_surface(db):
    return out(surface(db), ["cell_key", "part", "bin", "n", "grain"], DELTA_COLUMNS)


_PREDICTED = f"""pr AS MATERIALIZED (SELECT l.cell_key, l.date, l.bias AS truth, {', '.join(f's.q[{i + 1}] AS {d}' for i, d in enumerate(DELTA_COLUMNS))} FROM labelled l JOIN sf s ON s.cell_key = l.cell_key
    AND s.part = CAST(least(7, floor((dayofyear(date) - 1) * 8 / 366)) AS INT) AND s.bin = len(list_filter(s.edges, lambda e: e <= l.hres)) WHERE role = 'test')"""
_DELTA_OF = dict(zip(LEVELS, DELTA_COLUMNS))
_BAKED = ", ".join(f"round_even(q[{i + 1}] + {'0' if p == 0.5 else f'(SELECT shift FROM sh WHERE level = {p})'}, 2) AS {d}" for i, (p, d) in enumerate(zip(LEVELS, DELTA_COLUMNS)))


@query(
    "bake_surface",
    f"""WITH sf AS MATERIALIZED (SELECT * FROM {SURFACE_SQL}), {_PREDICTED}, sh AS MATERIALIZED ({_shift_union('pr', [], None, _DELTA_OF)}),
      t AS (SELECT cell_key, min(hres) AS lo, max(hres) AS hi FROM labelled WHERE role = 'train' GROUP BY 1), a AS (SELECT cell_key, unnest({_ROUNDED.format(x=_LIN.format(k=15, m=14))}) AS hres FROM t),
      gr AS (SELECT a.cell_key, a.hres, CAST(1 + 7 * range AS INT) AS doy FROM a CROSS JOIN range(0, 53)),
      bk AS (SELECT gr.cell_key, gr.hres, gr.doy, {_BAKED} FROM gr JOIN sf s ON s.cell_key = gr.cell_key AND s.part = CAST(least(7, floor((doy - 1) * 8 / 366)) AS INT) AND s.bin = len(list_filter(s.edges, lambda e: e <= gr.hres)))
      SELECT cell_key, R6(hres) AS hres, doy, {_PIN} FROM bk""",
)
def bake_surface(db):
    return out(baked(db), ["cell_key", "doy"], ["hres", *DELTA_COLUMNS])


def baked(db, fitted=None):
    fitted = fitted if fitted is not None else surface(db)
    test = calibrate.predict(db.roles.where("role = 'test'").withColumn("doy", F.dayofyear("date")), fitted)
    shifts = calibrate.head_shifts(test, DELTA_COLUMNS, "bias")
    points = calibrate.value_anchors(db.roles.where("role = 'train'"), "hres", rain=False)
    return calibrate.bake(fitted, points, shifts, "tmax")


@query("bake_self_check")
def bake_self_check(db):
    """Baked lookup against the fitted surface at the test days' own, off-grid points."""
    fitted = surface(db)
    days = db.roles.where("role = 'test'").withColumn("doy", F.dayofyear("date"))
    exact = calibrate.predict(days, fitted).select("cell_key", "date", F.col("dmid").alias("_exact"))
    asked = days.select("cell_key", "date", F.lit("tmax").alias("var"), "doy", F.col("hres").alias("value"))
    found = calibrate.bilinear_lookup(asked, materialize(baked(db, fitted), "baked"), ["cell_key", "date"])
    gaps = exact.join(found, ["cell_key", "date"]).select("cell_key", F.abs(F.col("dmid") - F.col("_exact")).alias("gap"))
    return gaps.groupBy("cell_key").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.percentile("gap", F.lit(0.99)).alias("p99_gap"), F.max("gap").alias("max_gap"))


def model_rows(db):
    return models.with_features(pairs.attach_static(db.roles, db.static))


@query("fit_point_model")
def fit_point_model(db):
    """Median head by boosted trees: error on the held-out days, raw and corrected."""
    rows = model_rows(db)
    model = models.fit_point_model(rows.where("role = 'train'"))
    fixed = model.transform(rows.where("role = 'test'")).withColumn("corrected", F.col("hres") + F.col("point"))
    return ev.per_cell_scores(fixed, "era5", "hres", "corrected")


@query(
    "bakeoff",
    f"""WITH w AS (SELECT cell_key, bias, CAST(round_even(2 * (1 + 3 * abs(2 * (u - 0.5))), 0) AS INT) AS f FROM labelled WHERE role = 'train'),
      a AS (SELECT cell_key, quantile_cont(bias, [0.05, 0.5, 0.95]) AS q FROM (SELECT cell_key, bias, unnest(range(0, f)) AS i FROM w) GROUP BY 1),
      b AS (SELECT cell_key, quantile_cont(bias, [0.05, 0.5, 0.95]) AS q FROM w GROUP BY 1),
      m AS (SELECT 'weighted' AS fit, cell_key, round(q[1], 6) AS lo, q[2] AS mid, round(q[3], 6) AS hi FROM a UNION ALL SELECT 'plain', cell_key, round(q[1], 6), q[2], round(q[3], 6) FROM b)
      SELECT fit, count(*) AS n, R6(avg(abs(bias - mid))) AS mae, R6(avg(CAST(round(bias, 6) BETWEEN lo AND hi AS INT))) AS coverage, R6(avg(hi - lo)) AS width FROM labelled l JOIN m ON l.cell_key = m.cell_key WHERE role = 'test' GROUP BY 1""",
)
def bakeoff(db):
    """Weighted against plain fits: a weight enters a percentile as the value's frequency."""
    train = db.roles.where("role = 'train'")
    freq = F.bround(2 * pairs.tail_weight(F.col("u"), 3.0), 0).cast("int")
    probs = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))

    def fit(name, q):
        fitted = train.groupBy("cell_key").agg(q.alias("q"))
        return fitted.select("cell_key", F.lit(name).alias("fit"), F.round(F.col("q")[0], 6).alias("lo"), F.col("q")[1].alias("mid"), F.round(F.col("q")[2], 6).alias("hi"))

    both = fit("weighted", F.percentile("bias", probs, freq)).unionByName(fit("plain", F.percentile("bias", probs)))
    rows = db.roles.where("role = 'test'").join(both, "cell_key")
    inside = F.round("bias", 6).between(F.col("lo"), F.col("hi"))
    scores = rows.groupBy("fit").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("bias") - F.col("mid"))).alias("mae"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width")
    )
    return out(scores, ["fit", "n"], ["mae", "coverage", "width"])


GRAINS = {"cell": "cell_key", "tile": "concat('t', floor(cast(substring(cell_key, 2) AS INT) / 2))", "global": "'all'"}
FIT_LEVELS = (0.05, 0.5, 0.95)


@query(
    "weighted_bakeoff",
    """WITH l AS (SELECT *, concat('t', CAST(substr(cell_key, 2) AS INT) // 2) AS tile, CAST(floor((1 + 3.0::DOUBLE * abs(2 * (u - 0.5))) * 1e6 + 0.5) AS BIGINT) AS wt FROM labelled),
      g AS (SELECT 'cell' AS grain, cell_key AS k, * FROM l UNION ALL SELECT 'tile', tile, * FROM l UNION ALL SELECT 'global', 'all', * FROM l),
      c AS (SELECT grain, k, bias, sum(wt) OVER (PARTITION BY grain, k ORDER BY bias RANGE UNBOUNDED PRECEDING) AS cum, CAST(sum(wt) OVER (PARTITION BY grain, k) AS DOUBLE) AS tot FROM g WHERE role = 'train'),
      q AS (SELECT grain, k, round(min(CASE WHEN cum >= ceil(tot * 0.05::DOUBLE) THEN bias END), 6) AS lo, min(CASE WHEN cum >= ceil(tot * 0.5::DOUBLE) THEN bias END) AS mid, round(min(CASE WHEN cum >= ceil(tot * 0.95::DOUBLE) THEN bias END), 6) AS hi FROM c GROUP BY 1, 2)
      SELECT g.grain, count(*) AS n, R6(avg(abs(bias - mid))) AS mae, R6(avg(CAST(round(bias, 6) BETWEEN lo AND hi AS INT))) AS coverage, R6(avg(hi - lo)) AS width FROM g JOIN q ON q.grain = g.grain AND q.k = g.k WHERE role = 'test' GROUP BY 1""",
)
def weighted_bakeoff(db):
    """Fits by cumulative tail weight at the cell and at the fallbacks above it, where no group is bounded."""
    grains = F.explode(F.array(*[F.struct(F.lit(name).alias("grain"), F.expr(key).cast("string").alias("k")) for name, key in GRAINS.items()])).alias("_g")
    rows = db.roles.select("role", "bias", "u", grains).select("role", "bias", "u", "_g.grain", "_g.k")
    fits = weighted_quantiles(rows.where("role = 'train'"), ["grain", "k"], "bias", pairs.tail_weight(F.col("u"), 3.0), FIT_LEVELS)
    fits = fits.select("grain", "k", F.round(F.col("q")[0], 6).alias("lo"), F.col("q")[1].alias("mid"), F.round(F.col("q")[2], 6).alias("hi"))
    tested = rows.where("role = 'test'").join(fits, ["grain", "k"])
    inside = F.round("bias", 6).between(F.col("lo"), F.col("hi"))
    scores = tested.groupBy("grain").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("bias") - F.col("mid"))).alias("mae"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width")
    )
    return out(scores, ["grain", "n"], ["mae", "coverage", "width"])


# ---- band evaluation ---------------------------------------------------------------------


def _rung_rows(source, keys, having=""):
    group = ", ".join(keys) + ", " if keys else ""
    parts = []
    for r in ev.RUNGS:
        u = r / 100
        at = min(max(sum(p <= u for p in LEVELS) - 1, 0), len(LEVELS) - 2)
        parts.append(
            f"SELECT {group}{r} AS rung, count(*) AS n, avg(CAST(truth <= {inverse_sql(f'{u}::DOUBLE')} AS INT)) AS cov, avg(CAST({BAND_COLUMNS[at + 1]} - {BAND_COLUMNS[at]} <= 1e-9 AS INT)) AS flat FROM {source} {'GROUP BY ' + ', '.join(keys) if keys else ''} {having}"
        )
    return " UNION ALL ".join(parts)


@query("rung_coverage", f"SELECT rung, n, R6(cov) AS cov, R6(flat) AS flat, R6((cov - rung / 100.0::DOUBLE) * 100) AS err_pp FROM ({_rung_rows('banded', [])})")
def rung_coverage(db):
    return out(ev.rung_coverage(db.banded, "truth"), ["rung", "n"], ["cov", "flat", "err_pp"])


QUINTILES = """(SELECT b.*, len(list_filter(e, lambda x: x < q90 - q10)) AS part FROM (SELECT cell_key, date, truth, {c} FROM banded) b, (SELECT quantile_cont(q90 - q10, [0.2, 0.4, 0.6, 0.8]) AS e FROM banded))""".format(c=", ".join(BAND_COLUMNS))


@query(
    "rung_regimes",
    f"""WITH s AS MATERIALIZED (SELECT * FROM {QUINTILES}), r AS ({_rung_rows('s', ['part'], 'HAVING count(*) >= 500')})
      SELECT CAST(part AS INT) AS part, max(n) AS n, R6(max(abs(cov - rung / 100.0::DOUBLE) * 100)) AS worst_pp FROM r GROUP BY 1""",
)
def rung_regimes(db):
    rows = ev.equal_parts(db.banded, F.col("q90") - F.col("q10"), 5, "part")
    rungs = ev.rung_coverage(rows, "truth", ["part"], min_n=500)
    return rungs.groupBy("part").agg(F.max("n").alias("n"), r6(F.max(F.abs("err_pp"))).alias("worst_pp"))


MAGNITUDE, WIDTH = "mid", "q90 - q10"
_NTILES = " UNION ALL ".join(f"SELECT '{name}' AS grouping, ntile(5) OVER (ORDER BY {value}, cell_key, date) AS part, b.* FROM banded b" for name, value in (("magnitude", MAGNITUDE), ("width", WIDTH)))


@query(
    "rung_quintiles",
    f"""WITH s AS MATERIALIZED ({_NTILES}), r AS ({_rung_rows('s', ['grouping', 'part'], 'HAVING count(*) >= 500')})
      SELECT grouping, CAST(part AS INT) AS part, rung, n, R6(cov) AS cov, R6(flat) AS flat, R6((cov - rung / 100.0::DOUBLE) * 100) AS err_pp FROM r""",
)
def rung_quintiles(db):
    rows = ev.quintile_rungs(db.banded, "truth", {"magnitude": F.col("mid"), "width": F.col("q90") - F.col("q10")}, ["cell_key", "date"], min_n=500)
    return out(rows, ["grouping", "part", "rung", "n"], ["cov", "flat", "err_pp"])


def _tail_union(source, keys):
    group = ", ".join(keys)
    return " UNION ALL ".join(
        f"SELECT {group}, {p}::DOUBLE AS level, count(*) AS n, avg(CAST({f'truth <= {HEAD[p]}' if p < 0.5 else f'truth > {HEAD[p]}'} AS INT)) AS mass, {p if p < 0.5 else 1 - p!r}::DOUBLE AS nominal FROM {source} GROUP BY {group}" for p in SIDED
    )


@query("level_tail_mass", f"SELECT CAST(month AS INT) AS month, n, level, R6(mass) AS tail_mass, R6(mass / nominal) AS ratio FROM ({_tail_union('(SELECT *, month(date) AS month FROM banded)', ['month'])})")
def level_tail_mass(db):
    rows = ev.level_tail_mass(db.banded.withColumn("month", F.month("date")), ["month"], "truth")
    return out(rows, ["month", "n", "level"], ["tail_mass", "ratio"])


BINNED = f"""(SELECT b.*, CASE WHEN pct <= 0.01 THEN 'bottom 1%' WHEN pct <= 0.05 THEN '1-5%' WHEN pct <= 0.25 THEN '5-25%' WHEN pct <= 0.75 THEN '25-75%' WHEN pct <= 0.95 THEN '75-95%' WHEN pct <= 0.99 THEN '95-99%' ELSE 'top 1%' END AS bin
   FROM banded b JOIN {FORECAST_PCT} f ON b.cell_key = f.cell_key AND b.date = f.date)"""


@query("level_tail_by_bin", f"SELECT bin, n, level, R6(mass) AS tail_mass, R6(mass / nominal) AS ratio FROM ({_tail_union(BINNED, ['bin'])})")
def level_tail_by_bin(db):
    shares = pairs.forecast_share(db.roles.where("role = 'train'"), db.roles.where("role = 'test'"))
    bins = shares.select("cell_key", "date", pairs.forecast_bin(F.col("forecast_pct")).alias("bin"))
    return out(ev.level_tail_mass(db.banded.join(bins, ["cell_key", "date"]), ["bin"], "truth"), ["bin", "n", "level"], ["tail_mass", "ratio"])


WET_SPLIT = f"""wr AS MATERIALIZED (SELECT w.cell_key, w.date, w.hres, w.era5 - w.hres AS bias, l.role FROM wet_pairs w JOIN labelled l ON w.cell_key = l.cell_key AND w.date = l.date),
   eg AS (SELECT list_concat([1.0::DOUBLE], list_distinct(list_filter(quantile_cont(hres, [0.2, 0.4, 0.6, 0.75, 0.87, 0.95]), lambda e: e > 1))) AS edges FROM wr WHERE role = 'train' AND hres >= 1),
   tb AS MATERIALIZED (SELECT wr.*, len(list_filter(edges, lambda e: e <= hres)) AS bin FROM wr, eg),
   cs AS MATERIALIZED ({_shift_union("(SELECT * FROM tb WHERE role = 'train')", ['cell_key'], 'bias')}), bs AS MATERIALIZED ({_shift_union("(SELECT * FROM tb WHERE role = 'train')", ['bin'], 'bias')}),
   ts AS MATERIALIZED (SELECT t.*, (SELECT count(*) FROM tb r WHERE r.role = 'train' AND r.cell_key = t.cell_key AND r.hres <= t.hres) / (SELECT count(*) FROM tb r WHERE r.role = 'train' AND r.cell_key = t.cell_key)::DOUBLE AS pct,
       (SELECT shift FROM cs WHERE cs.cell_key = t.cell_key AND level = 0.05) AS c_lo, (SELECT shift FROM cs WHERE cs.cell_key = t.cell_key AND level = 0.95) AS c_hi,
       (SELECT shift FROM bs WHERE bs.bin = t.bin AND level = 0.05) AS b_lo, (SELECT shift FROM bs WHERE bs.bin = t.bin AND level = 0.95) AS b_hi FROM tb t WHERE role = 'test')"""


@query(
    "regime_band_compare",
    f"""WITH {WET_SPLIT} SELECT CASE WHEN pct < 0.6 THEN 'dry / <p60' WHEN pct < 0.8 THEN 'p60-80' WHEN pct < 0.9 THEN 'p80-90' WHEN pct < 0.95 THEN 'p90-95' WHEN pct < 0.99 THEN 'p95-99' ELSE 'top 1%' END AS regime, count(*) AS n,
        R6(avg(CAST(bias BETWEEN c_lo AND c_hi AS INT))) AS constant_90, R6(avg(CAST(bias BETWEEN b_lo AND b_hi AS INT))) AS conditional_90, R6(avg(CAST(bias <= c_hi AS INT))) AS constant_q95, R6(avg(CAST(bias <= b_hi AS INT))) AS conditional_q95 FROM ts GROUP BY 1""",
)
def regime_band_compare(db):
    rows = wet_bias(db).join(db.roles.select("cell_key", "date", "role"), ["cell_key", "date"])
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    edges = calibrate.rain_edges(train)
    per_cell = calibrate.as_row(calibrate.conformal_shifts(train, ["cell_key"], "bias"), ["cell_key"])
    per_bin = calibrate.as_row(calibrate.conditional_shifts(train, edges), ["bin"])
    regimes = pairs.forecast_share(train, test)
    constant = per_cell.select("cell_key", F.col("dlo").alias("c_lo"), F.col("dhi").alias("c_hi"))
    conditional = per_bin.select("bin", F.col("dlo").alias("b_lo"), F.col("dhi").alias("b_hi"))
    joined = calibrate.bin_join(regimes.join(constant, "cell_key"), edges, conditional, "hres")

    def inside(lo, hi):
        return F.avg(F.col("bias").between(F.col(lo), F.col(hi)).cast("double"))

    scores = joined.groupBy(pairs.forecast_regime(F.col("forecast_pct")).alias("regime")).agg(
        F.count(F.lit(1)).alias("n"), inside("c_lo", "c_hi").alias("constant_90"), inside("b_lo", "b_hi").alias("conditional_90"),
        F.avg((F.col("bias") <= F.col("c_hi")).cast("double")).alias("constant_q95"), F.avg((F.col("bias") <= F.col("b_hi")).cast("double")).alias("conditional_q95"),
    )
    return out(scores, ["regime", "n"], ["constant_90", "conditional_90", "constant_q95", "conditional_q95"])


@query(
    "version_coverage",
    "SELECT level, R6(new) AS new, R6(same) AS same_season, R6(other) AS other, R6(new - same) AS gap_season_pp, R6(new - other) AS gap_other_pp FROM ("
    + " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS level, 100.0 * avg(CAST(truth <= {HEAD[p]} AS INT)) FILTER (fc_version = 'v3') AS new, 100.0 * avg(CAST(truth <= {HEAD[p]} AS INT)) FILTER (fc_version <> 'v3' AND season = 'JJA') AS same, 100.0 * avg(CAST(truth <= {HEAD[p]} AS INT)) FILTER (fc_version <> 'v3') AS other FROM {BANDED_LABELLED}"
        for p in SIDED
    )
    + ")",
)
def version_coverage(db):
    rows = ev.version_coverage(banded_labelled(db), "truth", "v3", F.col("season") == "JJA")
    return out(rows, ["level"], ["new", "same_season", "other", "gap_season_pp", "gap_other_pp"])


_BIN = "CAST(greatest(0, ceil(round({c} * 20, 9)) - 1) AS INT)"


def _reliability(source, claim):
    centre = "(r + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n)"
    half = _wilson_half("r", "n")
    return f"""(SELECT bin, n, c AS mean_claim, r AS realized, {centre} - {half} AS lo, {centre} + {half} AS hi, 100 * (r - c) AS gap_pp, {centre} - {half} <= c AND c <= {centre} + {half} AS diag_in
       FROM (SELECT {_BIN.format(c=claim)} AS bin, count(*) AS n, avg({claim}) AS c, avg(hit) AS r FROM {source} GROUP BY 1))"""


# nine decimals first: a tie at the sixth must not hang on the order of a sum
_REL = ", ".join(f"R6(round({c}, 9)) AS {c}" for c in ("mean_claim", "realized", "lo", "hi", "gap_pp"))


@query(
    "reliability",
    f"""WITH {CLAIM_SQL} SELECT 'claimed' AS shown, bin, n, {_REL}, diag_in FROM {_reliability('claims', 'claimed_p')}
        UNION ALL SELECT 'displayed', bin, n, {_REL}, diag_in FROM {_reliability('(SELECT displayed / 100.0::DOUBLE AS d, hit FROM claims)', 'd')}""",
)
def reliability(db):
    made = claims(db)
    both = made.select(F.lit("claimed").alias("shown"), F.col("claimed_p").alias("c"), "hit").unionByName(
        made.select(F.lit("displayed").alias("shown"), (F.col("displayed") / 100).alias("c"), "hit")
    )
    values = ["mean_claim", "realized", "lo", "hi", "gap_pp"]
    rows = ev.reliability(both, ["shown"], "c")
    return out(rows.withColumns({v: F.round(v, 9) for v in values}), ["shown", "bin", "n", "diag_in"], values)


@query("ece", f"WITH {CLAIM_SQL} SELECT R6(100 * sum(n * abs(realized - mean_claim)) / sum(n)) AS ece_pp FROM {_reliability('claims', 'claimed_p')}")
def ece(db):
    return out(ev.ece(claims(db)), [], ["ece_pp"])


TIER_SQL = f"(SELECT tier, n, c AS claim, r AS realized, 100 * (r - c) AS gap_pp, 100 * {_wilson_half('r', 'n')} AS half_pp FROM (SELECT tier, count(*) AS n, avg(claimed_p) AS c, avg(hit) AS r FROM claims GROUP BY 1))"


@query("tier_reliability", f"WITH {CLAIM_SQL} SELECT tier, n, R6(claim) AS claim, R6(realized) AS realized, R6(gap_pp) AS gap_pp, R6(half_pp) AS half_pp FROM {TIER_SQL}")
def tier_reliability(db):
    return out(ev.tier_reliability(claims(db)), ["tier", "n"], ["claim", "realized", "gap_pp", "half_pp"])


@query(
    "tier_level_coverage",
    f"WITH {CLAIM_SQL} SELECT tier, n, level, R6(100 * (cov - level)) AS err_pp FROM ("
    + " UNION ALL ".join(f"SELECT tier, count(*) AS n, {p}::DOUBLE AS level, avg(CAST(truth <= {HEAD[p]} AS INT)) AS cov FROM claims GROUP BY 1 HAVING count(*) >= 20" for p in LEVELS)
    + ")",
)
def tier_level_coverage(db):
    return out(ev.level_coverage(claims(db), ["tier"], "truth", min_n=20), ["tier", "n", "level"], ["err_pp"])


@query(
    "gates",
    f"""WITH {CLAIM_SQL}, bn AS (SELECT * FROM {_reliability('claims', 'claimed_p')}), tr AS (SELECT * FROM {TIER_SQL}),
      x AS (SELECT (SELECT 100 * sum(n * abs(realized - mean_claim)) / sum(n) FROM bn) AS e, (SELECT count_if(n >= 50 AND abs(gap_pp) > 5 AND NOT diag_in) FROM bn) AS f, (SELECT count_if(n >= 50 AND gap_pp < -5) FROM tr) AS s)
      SELECT R6(e) AS ece_pp, f AS bins_failing, s AS tiers_sagging, CASE WHEN e <= 3 AND f = 0 AND s = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x""",
)
def gates(db):
    return out(ev.calibration_gates(claims(db), min_n=50), ["bins_failing", "tiers_sagging", "verdict"], ["ece_pp"])


@query("rung_gates", f"SELECT R6(max(abs(cov - rung / 100.0::DOUBLE) * 100)) AS max_err_pp, CASE WHEN max(abs(cov - rung / 100.0::DOUBLE) * 100) <= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_rung_rows('banded', [])})")
def rung_gates(db):
    return out(ev.rung_gates(ev.rung_coverage(db.banded, "truth"), 2.0), ["verdict"], ["max_err_pp"])


@query(
    "binomial_luck",
    """WITH c AS (SELECT cell_key, year(date) AS year, count(*) AS n, avg(CAST(truth BETWEEN q10 AND q90 AS INT)) AS coverage FROM banded GROUP BY 1, 2), m AS (SELECT DISTINCT n FROM c),
      f AS (SELECT n, range AS k, sum(exp(lgamma(n + 1) - lgamma(range + 1) - lgamma(n - range + 1) + range * ln(0.8) + (n - range) * ln(0.2))) OVER (PARTITION BY n ORDER BY range) AS cdf FROM m, LATERAL (SELECT unnest(range(0, n + 1)) AS range)),
      l AS (SELECT n, min(k) / n::DOUBLE AS line FROM f WHERE cdf >= 0.025 GROUP BY n)
      SELECT cell_key, year, c.n, R6(coverage) AS coverage, R6(line) AS luck_line, coverage < line AS below_luck FROM c JOIN l ON c.n = l.n""",
)
def binomial_luck(db):
    by_cell = ev.band_coverage(db.banded.withColumn("year", F.year("date")), ["cell_key", "year"], "truth", "q10", "q90", 0.8)
    return out(ev.binomial_luck(by_cell, 0.8), ["cell_key", "year", "n", "below_luck"], ["coverage", "luck_line"])


CUTS, RAMPS = (0.0, 35.0, 38.0, 41.0), ((34.0, 40.0),)
_SETTINGS = [(f"switch {c:g}", f"CASE WHEN raw >= {c} THEN mapped ELSE corrected END", f"raw >= {c}") for c in CUTS] + [
    (f"ramp {a:g}-{b:g}", f"(1 - {w}) * corrected + {w} * mapped", f"{w} > 0") for a, b in RAMPS for w in [f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (raw - {a}) / {b - a}))"]
]


@query(
    "hybrid_sweep",
    f"WITH s AS MATERIALIZED (SELECT * FROM {SCORED}), t AS (SELECT quantile_cont(truth, {_QQ}) AS tq FROM s) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS setting, R6(h) AS high_pct, R6(m) AS mae, b AS big_miss, R6(list_avg(list_transform(range(1, {len(QQ_LEVELS) + 1}), lambda i: abs(pq[i] - tq[i])))) AS qq_gap FROM (SELECT 100.0 * avg(CAST({u} AS INT)) AS h, avg(abs(truth - ({p}))) AS m, count_if(abs(truth - ({p})) >= {BIG}) AS b, quantile_cont({p}, {_QQ}) AS pq FROM s), t"
        for n, p, u in _SETTINGS
    ),
)
def hybrid_sweep(db):
    rows = ev.hybrid_sweep(scored(db), "truth", "corrected", "mapped", "raw", CUTS, RAMPS, BIG, QQ_LEVELS)
    return out(rows, ["setting", "big_miss"], ["high_pct", "mae", "qq_gap"])


@query(
    "shoulder_check",
    f"""SELECT fdec, count(*) AS n, R6((avg(CAST(truth <= mid - 0.526307::DOUBLE * (mid - q10) AS INT)) - 0.25) * 100) AS q25_probit_pp, R6((avg(CAST(truth <= mid + 0.526307::DOUBLE * (q90 - mid) AS INT)) - 0.75) * 100) AS q75_probit_pp,
        R6((avg(CAST(truth <= mid - 0.625::DOUBLE * (mid - q10) AS INT)) - 0.25) * 100) AS q25_linear_pp, R6((avg(CAST(truth <= mid + 0.625::DOUBLE * (q90 - mid) AS INT)) - 0.75) * 100) AS q75_linear_pp FROM {BANDED_LABELLED} GROUP BY 1""",
)
def shoulder_check(db):
    rows = ev.shoulder_check(banded_labelled(db), ["fdec"], "truth")
    return out(rows, ["fdec", "n"], ["q25_probit_pp", "q75_probit_pp", "q25_linear_pp", "q75_linear_pp"])


@query("predictive_density")
def predictive_density(db):
    """Peak and mass of every forecast day's density curve."""
    curves = ev.predictive_density(db.banded, BAND_COLUMNS, axis_span=30.0)
    step = (F.element_at("curve", -1)["t"] - F.col("curve")[0]["t"]) / ev.DENSITY_STEPS
    mass = F.aggregate("curve", F.lit(0.0), lambda s, p: s + p["d"]) * step
    peak = F.array_max(F.transform("curve", lambda p: F.struct(p["d"].alias("d"), p["t"].alias("t"))))
    return curves.select("cell_key", "date", peak["t"].alias("peak_at"), peak["d"].alias("peak"), mass.alias("mass"))
