"""Finer cuts of the traffic, search, cell and claim reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from isotherm.functions.rounding import r6
from isotherm.operators import calibrate, cells, pairs, traffic
from isotherm.operators import evaluate as ev
from isotherm.plans.climatology import CLAIM_SQL, claims
from isotherm.plans.evaluation import SIDED, STUDY_SQL, WET_SPLIT, out, studied, wet_bias
from isotherm.plans.joins import MOVERS_SQL, movers
from isotherm.plans.registry import REGISTRY, query
from isotherm.session import materialize
from isotherm.plans.traffic import _wind, label_repairs

# ---- traffic -----------------------------------------------------------------------------


@query("people_per_country", "SELECT country, count(*) AS hits, count(DISTINCT visitor) AS people FROM hits GROUP BY 1")
def people_per_country(db):
    return traffic.people_by(db.hits, "country")


@query(
    "metric_tops",
    r"""WITH m AS (SELECT regexp_extract(page, '^/(-?\d+\.\d+),(-?\d+\.\d+)/(\d{4}-\d{2}-\d{2})/(\w+)', 4) AS metric FROM hits)
        SELECT metric, count(*) AS n, R6(100.0 * count(*) / (SELECT count(*) FROM m WHERE metric <> '')) AS pct FROM m WHERE metric <> '' GROUP BY 1""",
)
def metric_tops(db):
    return traffic.metric_tops(db.hits).withColumn("pct", r6(F.col("pct")))


FETCHED_SQL = r"""(SELECT country, CASE WHEN event_id % 4 = 0 THEN concat('/forecast/forecast_', regexp_extract(page, '^/([0-9.]+),', 1), '_', regexp_extract(page, ',([0-9.]+)', 1), '.csv') ELSE page END AS page FROM hits)"""


@query(
    "link_views",
    rf"""WITH p AS {FETCHED_SQL}, l AS (
        SELECT 'forecast' AS kind, regexp_extract(page, '/forecast/forecast_(-?\d+\.\d+)_(-?\d+\.\d+)\.csv', 1) AS a, regexp_extract(page, '/forecast/forecast_(-?\d+\.\d+)_(-?\d+\.\d+)\.csv', 2) AS o, country FROM p
        UNION ALL SELECT 'card', regexp_extract(page, '^/(-?\d+\.\d+),(-?\d+\.\d+)/(\d{{4}}-\d{{2}}-\d{{2}})/(\w+)', 1), regexp_extract(page, '^/(-?\d+\.\d+),(-?\d+\.\d+)/(\d{{4}}-\d{{2}}-\d{{2}})/(\w+)', 2), country FROM p)
        SELECT kind, CAST(a AS DOUBLE) AS lat, CAST(o AS DOUBLE) AS lon, count(*) AS views, count(DISTINCT country) AS countries FROM l WHERE a <> '' GROUP BY 1, 2, 3""",
)
def link_views(db):
    """Every fourth page view is the fetch of the location's forecast file."""
    lat, lon = F.regexp_extract("page", r"^/([0-9.]+),", 1), F.regexp_extract("page", r",([0-9.]+)", 1)
    fetched = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("/forecast/forecast_"), lat, F.lit("_"), lon, F.lit(".csv"))).otherwise(F.col("page"))
    return traffic.link_views(db.hits.withColumn("page", fetched))


@query(
    "search_distances",
    "SELECT count(*) AS n, R6(quantile_cont(dist_km, 0.5)) AS p50, R6(quantile_cont(dist_km, 0.9)) AS p90, R6(quantile_cont(dist_km, 0.99)) AS p99, R6(max(dist_km)) AS p100 FROM hits WHERE kind = 'search' AND dist_km IS NOT NULL",
)
def search_distances(db):
    return out(traffic.search_distances(db.hits), ["n"], ["p50", "p90", "p99", "p100"])


@query("worst_searches", "SELECT query, R6(max(dist_km)) AS worst_km, count(*) AS searches FROM hits WHERE kind = 'search' GROUP BY 1 HAVING max(dist_km) IS NOT NULL ORDER BY max(dist_km) DESC, query LIMIT 20")
def worst_searches(db):
    return traffic.worst_searches(db.hits, 20).withColumn("worst_km", r6(F.col("worst_km")))


@query("never_matched", "SELECT query, count(*) AS searches FROM hits WHERE kind = 'search' GROUP BY 1 HAVING count(matched) = 0")
def never_matched(db):
    return traffic.never_matched(db.hits)


# ---- the cell list -----------------------------------------------------------------------


@query("snap_histogram", f"SELECT CAST(floor(snap_km) AS INT) AS km, count(*) AS n FROM {MOVERS_SQL} GROUP BY 1")
def snap_histogram(db):
    return cells.snap_histogram(movers(db))


@query(
    "existing_destinations",
    f"""WITH m AS MATERIALIZED (SELECT * FROM {MOVERS_SQL}) SELECT new_lat, new_lon, count(*) AS movers FROM m
        WHERE EXISTS (SELECT 1 FROM cells c WHERE c.lat = m.new_lat AND c.lon = m.new_lon) AND NOT EXISTS (SELECT 1 FROM m a WHERE a.lat = m.new_lat AND a.lon = m.new_lon) GROUP BY 1, 2""",
)
def existing_destinations(db):
    return cells.existing_destinations(movers(db), db.cells)


@query(
    "region_splice",
    f"""WITH s AS (SELECT c.*, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN concat(label, ', Shire ', cell_id % 3) ELSE label END AS spliced FROM cells c),
      g AS (SELECT spliced, avg(lat) AS clat, avg(lon) AS clon FROM s GROUP BY 1),
      r AS (SELECT s.*, row_number() OVER (PARTITION BY s.spliced ORDER BY population DESC, cell_id) AS pr, concat(s.spliced, ' (', {_wind('clat', 'clon', 'lat', 'lon')}, ')') AS cand FROM s JOIN g ON s.spliced = g.spliced),
      w AS (SELECT cand, cell_id, row_number() OVER (PARTITION BY cand ORDER BY population DESC, cell_id) AS wr FROM r WHERE pr > 1)
      SELECT r.cell_id, CASE WHEN pr = 1 THEN spliced WHEN wr = 1 THEN r.cand ELSE concat(spliced, ' (', printf('%.1f', lat + 0.0), ', ', printf('%.1f', lon + 0.0), ')') END AS unique_name FROM r LEFT JOIN w ON r.cell_id = w.cell_id""",
)
def region_splice(db):
    """Labels held by several cells take their region first."""
    rows = db.cells.withColumn("region", F.concat(F.lit("Shire "), F.col("cell_id") % 3))
    return cells.unique_names(rows, "label", "region").select("cell_id", "unique_name")


LABELS_SQL = "(SELECT cell_id, concat('Place ', cell_id % 40, ', Shire ', cell_id % 3, ', Land ', country, CASE WHEN cell_id % 4 = 0 THEN ' (NW)' ELSE '' END) AS name FROM cells)"
_TAIL = r"trim(regexp_extract(regexp_replace({}, '\s*\([^)]*\)$', ''), '([^,]*)$', 1))"


@query(
    "tail_proof",
    f"""WITH repairs AS ({REGISTRY['label_repairs'].sql}), l AS {LABELS_SQL},
      n AS (SELECT 'dropped' AS repair, l.name AS old, coalesce(r.dropped, l.name) AS new FROM l LEFT JOIN repairs r ON r.cell_id = l.cell_id UNION ALL SELECT 'retailed', l.name, coalesce(r.retailed, l.name) FROM l LEFT JOIN repairs r ON r.cell_id = l.cell_id),
      b AS (SELECT repair, {_TAIL.format('old')} AS tail, count(*) AS before FROM n GROUP BY 1, 2), a AS (SELECT repair, {_TAIL.format('new')} AS tail, count(*) AS after FROM n GROUP BY 1, 2),
      d AS (SELECT coalesce(b.repair, a.repair) AS repair, coalesce(b.tail, a.tail) AS tail, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a ON a.repair = b.repair AND a.tail = b.tail)
      SELECT repair, tail, before, after, before <> after AS changed FROM d""",
)
def tail_proof(db):
    """Cells per country tail before and after each repair: dropping a leading place changes none, a new tail moves cells between countries."""
    name = F.concat(
        F.lit("Place "), F.col("cell_id") % 40, F.lit(", Shire "), F.col("cell_id") % 3, F.lit(", Land "), F.col("country"), F.when(F.col("cell_id") % 4 == 0, " (NW)").otherwise("")
    )
    before = db.cells.select("cell_id", name.alias("name"))
    repaired = before.join(label_repairs(db).select("cell_id", "dropped", "retailed"), "cell_id", "left")
    rows = None
    for repair in ("dropped", "retailed"):
        after = repaired.select("cell_id", F.coalesce(repair, "name").alias("name"))
        counts = cells.tail_counts(before, after, changed_only=False).withColumn("repair", F.lit(repair))
        rows = counts if rows is None else rows.unionByName(counts)
    return rows.select("repair", "tail", "before", "after", (F.col("before") != F.col("after")).alias("changed"))


# ---- errors and claims -------------------------------------------------------------------

_EIGHTHS = ", ".join(str(i / 8) for i in range(9))


@query(
    "feature_rates",
    " UNION ALL ".join(
        f"""SELECT metric, '{name}' AS feature, bin, count(*) AS days, R6(100.0 * avg(CAST(abs(diff) > 3 AS INT))) AS rate_pct FROM (
            SELECT t.metric, diff, len(list_filter(edges, lambda x: x < {value})) - 1 AS bin FROM {STUDY_SQL} t JOIN (SELECT metric, list_sort(list_distinct(quantile_cont({value}, [{_EIGHTHS}]))) AS edges FROM {STUDY_SQL} GROUP BY 1) e ON e.metric = t.metric)
          WHERE bin >= 0 GROUP BY 1, 3"""
        for name, value in (("abs_elev_diff", "abs(elev_diff_m)"), ("abs_lat", "abs(lat)"), ("forecast", "hres"))
    ),
)
def feature_rates(db):
    features = {"abs_elev_diff": F.abs("elev_diff_m"), "abs_lat": F.abs("lat"), "forecast": F.col("hres")}
    return out(ev.feature_rates(studied(db), ["metric"], features, F.abs("diff") > 3), ["metric", "feature", "bin", "days"], ["rate_pct"])


REGIME_SQL = "CASE WHEN pct < 0.6 THEN 'dry / <p60' WHEN pct < 0.8 THEN 'p60-80' WHEN pct < 0.9 THEN 'p80-90' WHEN pct < 0.95 THEN 'p90-95' WHEN pct < 0.99 THEN 'p95-99' ELSE 'top 1%' END"


@query(
    "regime_rungs",
    f"""WITH {WET_SPLIT} SELECT {REGIME_SQL} AS regime, cs.level, count(*) AS n, R6(avg(CAST(bias <= cs.shift AS INT))) AS constant, R6(avg(CAST(bias <= bs.shift AS INT))) AS conditional
        FROM ts JOIN cs ON cs.cell_key = ts.cell_key JOIN bs ON bs.bin = ts.bin AND bs.level = cs.level GROUP BY 1, 2""",
)
def regime_rungs(db):
    """One-sided coverage at every level, constant against conditional band, by forecast regime: all levels in one pass."""
    roles = db.roles.select("cell_key", "date", "role")
    # stored: training and test rows are read by several passes
    rows = materialize(wet_bias(db).join(roles, ["cell_key", "date"]), "wet")
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    edges = calibrate.rain_edges(train)
    names = {p: calibrate.SIDED_NAMES[p] for p in SIDED}
    constant = calibrate.as_row(calibrate.conformal_shifts(train, ["cell_key"], "bias"), ["cell_key"]).select("cell_key", *[F.col(c).alias(f"c_{c}") for c in names.values()])
    conditional = calibrate.as_row(calibrate.conditional_shifts(train, edges), ["bin"]).select("bin", *[F.col(c).alias(f"b_{c}") for c in names.values()])
    joined = calibrate.bin_join(pairs.forecast_share(train, test).join(constant, "cell_key"), edges, conditional, "hres")
    shares = [F.avg((F.col("bias") <= F.col(f"{k}_{c}")).cast("double")).alias(f"{k}_{c}") for c in names.values() for k in "cb"]
    wide = joined.groupBy(pairs.forecast_regime(F.col("forecast_pct")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), *shares)
    levels = F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"c_{c}").alias("constant"), F.col(f"b_{c}").alias("conditional")) for p, c in names.items()])).alias("_l")
    return out(wide.select("regime", "n", levels).select("regime", "n", "_l.*"), ["regime", "level", "n"], ["constant", "conditional"])


@query(
    "extreme_claims",
    f"""WITH {CLAIM_SQL}, g AS (SELECT claimed_p >= 0.8 AS sure, count(*) AS n, avg(claimed_p) AS c, avg(hit) AS r FROM claims WHERE tier = 'extreme' GROUP BY 1),
      wil AS (SELECT *, (r + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS m, 1.96::DOUBLE * sqrt(r * (1 - r) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS h FROM g)
      SELECT sure, n, R6(round(c, 9)) AS claim, R6(round(r, 9)) AS realized, R6(round(m - h, 9)) AS lo, R6(round(m + h, 9)) AS hi FROM wil""",
)
def extreme_claims(db):
    """The strongest verdict's claims, those of 80 percent and more apart."""
    values = ["claim", "realized", "lo", "hi"]
    rows = ev.claim_split(claims(db), "extreme", 0.8)
    return out(rows.withColumns({v: F.round(v, 9) for v in values}), ["sure", "n"], values)
