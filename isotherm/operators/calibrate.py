"""Calibration, gating, grids and the lookup of correction surfaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions import bands, derive
from isotherm.functions.rounding import half_even
from isotherm.operators.order_stats import conformal_position, order_statistics, quantiles
from isotherm.schemas import DELTA_COLUMNS, LEVELS, TRACE_MM

# Parameters of the grid: weekly day anchors, value anchors, and the levels and points used for rain.
DOY_ANCHORS = tuple(range(1, 366, 7))
VALUE_ANCHORS = 15
RAIN_QUANTILES = (0.0, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 1.0)
RAIN_LINEAR = 6
RAIN_EDGES = (0.20, 0.40, 0.60, 0.75, 0.87, 0.95)
GATED_DOYS = (1, 183)
GATE_LIMIT = 0.1
SIDED = tuple(p for p in LEVELS if p != 0.5)
SIDED_NAMES = dict(zip(LEVELS, DELTA_COLUMNS))


def conformal_shifts(df: DataFrame, keys: Sequence[str], residual: str, levels: Sequence[float] = SIDED) -> DataFrame:
    """One-sided finite-sample order statistic of the residual per level: keys, ``level``, ``n``, ``shift``.

    Pools over the whole table stay distributed; see ``order_stats``.
    """

    def positions(n: Column) -> Column:
        return F.array(*[conformal_position(n, p) for p in levels])

    level = F.element_at(F.array(*[F.lit(p) for p in levels]), F.col("i") + 1)
    found = order_statistics(df, keys, residual, positions)
    return found.select(*keys, level.alias("level"), "n", F.col("v").alias("shift"))


def head_shifts(df: DataFrame, heads: Sequence[str], truth: str, keys: Sequence[str] = (), levels: Sequence[float] = LEVELS) -> DataFrame:
    """Shift of every head of a band; each level is calibrated on its own residual, the median not at all."""
    residuals = F.explode(
        F.array(*[F.struct(F.lit(p).alias("level"), (F.col(truth) - F.col(h)).alias("r")) for h, p in zip(heads, levels) if p != 0.5])
    )
    long = df.select(*keys, residuals.alias("_e")).select(*keys, "_e.level", "_e.r")

    def position(n: Column) -> Column:
        ranks = [F.when(F.col("_k.level") == p, conformal_position(n, p)) for p in levels if p != 0.5]
        return F.array(F.coalesce(*ranks))

    found = order_statistics(long, [*keys, "level"], "r", position)
    return found.select(*keys, "level", "n", F.col("v").alias("shift"))


def as_row(shifts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shifts by level as nine delta columns; the median head is 0."""
    columns = [
        F.lit(0.0).alias(SIDED_NAMES[p]) if p == 0.5 else F.max(F.when(F.col("level") == p, F.col("shift"))).alias(SIDED_NAMES[p])
        for p in LEVELS
    ]
    return shifts.groupBy(*keys).agg(*columns).select(*keys, *DELTA_COLUMNS)


def symmetric_shift(df: DataFrame, lo: str, hi: str, truth: str, keys: Sequence[str] = (), share: float = 0.9) -> DataFrame:
    """The two-sided constant that widens both ends of a band alike."""
    score = F.greatest(F.col(lo) - F.col(truth), F.col(truth) - F.col(hi))
    found = order_statistics(df.select(*keys, score.alias("_s")), keys, "_s", lambda n: F.array(conformal_position(n, share)))
    return found.select(*keys, "n", F.col("v").alias("shift"))


def sort_heads(df: DataFrame, heads: Sequence[str] = DELTA_COLUMNS) -> DataFrame:
    """Heads of each row in ascending order."""
    ordered = F.array_sort(F.array(*heads))
    return df.withColumn("_h", ordered).withColumns({h: F.col("_h")[i] for i, h in enumerate(heads)}).drop("_h")


def pin_heads(df: DataFrame, heads: Sequence[str] = DELTA_COLUMNS, digits: int = 2) -> DataFrame:
    """Two decimals, then monotone around the median."""
    rounded = df.withColumns({h: half_even(F.col(h), digits) for h in heads})
    return rounded.withColumns(dict(zip(heads, bands.pin_median([F.col(h) for h in heads]))))


def linspace(low: Column, high: Column, points: int) -> Column:
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    return F.transform(steps, lambda i: F.when(i == points - 1, high).otherwise(low + i * ((high - low) / (points - 1))))


def value_anchors(train: DataFrame, value: str, rain: bool, keys: Sequence[str] = ("cell_key",)) -> DataFrame:
    """Forecast values at which a cell's surface is tabulated; at least two of them."""
    low, high = F.min(value), F.max(value)
    spread = train.groupBy(*keys).agg(
        low.alias("_lo"), high.alias("_hi"), F.percentile(value, F.array(*[F.lit(q) for q in RAIN_QUANTILES])).alias("_q")
    )
    raw = F.concat("_q", linspace(F.col("_lo"), F.col("_hi"), RAIN_LINEAR)) if rain else linspace(F.col("_lo"), F.col("_hi"), VALUE_ANCHORS)
    rounded = F.array_sort(F.array_distinct(F.transform(raw, lambda a: half_even(a, 2))))
    return spread.withColumn("_a", rounded).select(*keys, _at_least_two(F.col("_a")).alias("anchors"))


def end_anchors(train: DataFrame, value: str, keys: Sequence[str] = ("cell_key",)) -> DataFrame:
    """The two ends of a cell's forecasts, for surfaces that do not vary between them."""
    ends = train.groupBy(*keys).agg(half_even(F.min(value), 2).alias("_lo"), half_even(F.max(value), 2).alias("_hi"))
    return ends.select(*keys, _at_least_two(F.array_distinct(F.array("_lo", "_hi"))).alias("anchors"))


def _at_least_two(anchors: Column) -> Column:
    return F.when(F.size(anchors) >= 2, anchors).otherwise(F.array(anchors[0], anchors[0] + 0.01))


def grid(anchors: DataFrame, doys: Sequence[int] = DOY_ANCHORS, keys: Sequence[str] = ("cell_key",)) -> DataFrame:
    """Every value anchor at every day anchor of a cell."""
    return anchors.select(*keys, F.explode("anchors").alias("hres")).withColumn(
        "doy", F.explode(F.array(*[F.lit(d) for d in doys]))
    )


def gated_cells(scores: DataFrame, limit: float = GATE_LIMIT) -> DataFrame:
    """Cells whose correction makes the mean error worse by more than the limit."""
    return scores.where(F.col("mae_corrected") - F.col("mae_raw") > limit)


def gate_split(rows: DataFrame, gated: DataFrame, keys: Sequence[str] = ("cell_key", "var")) -> DataFrame:
    """``route``: empirical band where gated, model surface elsewhere."""
    marks = gated.select(*keys).distinct().withColumn("_g", F.lit(True))
    return rows.join(marks, list(keys), "left").withColumn(
        "route", F.when(F.col("_g"), "empirical").otherwise("model")
    ).drop("_g")


def rain_edges(fit: DataFrame, value: str = "hres") -> DataFrame:
    """One row: the distinct wet-forecast quantiles above the trace threshold, after it."""
    wet = quantiles(fit.where(F.col(value) >= TRACE_MM), [], value, RAIN_EDGES)
    inner = F.array_distinct(F.filter("q", lambda e: e > TRACE_MM))
    return wet.select(F.concat(F.array(F.lit(TRACE_MM)), inner).alias("edges"))


def conditional_shifts(fit: DataFrame, edges: DataFrame, residual: str = "bias", value: str = "hres") -> DataFrame:
    """Shifts per forecast bin, pooled over cells; an empty bin takes the pooled shifts.

    Result: ``bin``, ``level``, ``n``, ``shift`` for every bin of the edges.
    """
    binned = fit.join(F.broadcast(edges)).withColumn("bin", derive.search_bin(F.col("edges"), F.col(value)))
    own = conformal_shifts(binned, ["bin"], residual)
    pooled = conformal_shifts(fit, [], residual).select("level", F.col("shift").alias("_pool"))
    every = edges.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    frame = every.join(F.broadcast(pooled))
    return frame.join(own, ["bin", "level"], "left").select(
        "bin", "level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("shift", "_pool").alias("shift")
    )


def bin_join(rows: DataFrame, edges: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Attach the bin of each value and that bin's row of a table keyed by ``bin``."""
    binned = rows.join(F.broadcast(edges)).withColumn("bin", derive.search_bin(F.col("edges"), F.col(value))).drop("edges")
    return binned.join(F.broadcast(table), "bin")  # a handful of bins


def gated_table(anchors: DataFrame, shifts: DataFrame, var: str, keys: Sequence[str] = ("cell_key",)) -> DataFrame:
    """Surface rows of gated cells: constant over the year, same columns as any other.

    ``shifts`` holds delta columns by the keys, or by ``bin`` on top of anchors that carry one.
    """
    joined = anchors.select(*[c for c in anchors.columns if c != "anchors"], F.explode("anchors").alias("hres"))
    rows = joined.join(shifts, list(keys)).withColumn("doy", F.explode(F.array(*[F.lit(d) for d in GATED_DOYS])))
    return pin_heads(rows).withColumn("var", F.lit(var)).select("cell_key", "var", "doy", "hres", *DELTA_COLUMNS)


def bilinear_lookup(requests: DataFrame, surface: DataFrame, request_id: Sequence[str]) -> DataFrame:
    """Nine deltas per request: linear in the forecast value, circular-linear in the day.

    Requests carry ``cell_key``, ``var``, ``doy`` and ``value``. Each becomes at most four
    weighted corners, so the surface is met by one equi-join on its whole key and the
    corners are summed before they leave a task.
    """
    axes = surface.groupBy("cell_key", "var").agg(
        F.array_sort(F.collect_set("hres")).alias("_h"),  # at most 15 value anchors
        F.array_sort(F.collect_set("doy")).alias("_d"),  # at most 53 day anchors
    )
    ids = list(request_id)
    placed = requests.select(*ids, "cell_key", "var", F.col("doy").alias("_day"), F.col("value").alias("_value")).join(
        axes, ["cell_key", "var"]
    )
    value = F.least(F.greatest(F.col("_value"), F.col("_h")[0]), F.element_at("_h", -1))
    placed = placed.withColumn("_v", value).withColumn("_hi", F.size(F.filter("_h", lambda a: a < F.col("_v"))))
    placed = placed.withColumn("_lo", F.greatest(F.col("_hi") - 1, F.lit(0)))
    h0, h1 = F.get("_h", F.col("_lo")), F.get("_h", F.col("_hi"))
    below = F.array_max(F.filter("_d", lambda d: d <= F.col("_day")))
    above = F.array_min(F.filter("_d", lambda d: d >= F.col("_day")))
    placed = placed.withColumns(
        {
            "_h0": h0,
            "_h1": h1,
            "_d0": F.coalesce(below, F.element_at("_d", -1)),
            "_d1": F.coalesce(above, F.element_at("_d", 1)),
        }
    )
    tw = F.when(F.col("_h1") == F.col("_h0"), 0.0).otherwise((F.col("_v") - F.col("_h0")) / (F.col("_h1") - F.col("_h0")))
    span = F.pmod(F.col("_d1") - F.col("_d0"), F.lit(365))
    dw = F.pmod(F.col("_day") - F.col("_d0"), F.lit(365)) / F.when(span == 0, 1).otherwise(span)
    placed = placed.withColumn("_tw", tw).withColumn("_dw", dw)

    def corner(day: str, dweight: Column, at: str, tweight: Column) -> Column:
        return F.struct(F.col(day).alias("doy"), F.col(at).alias("hres"), (dweight * tweight).alias("w"))

    t, d = F.col("_tw"), F.col("_dw")
    corners = F.array(
        corner("_d0", 1 - d, "_h0", 1 - t), corner("_d0", 1 - d, "_h1", t), corner("_d1", d, "_h0", 1 - t), corner("_d1", d, "_h1", t)
    )
    exploded = (
        placed.select(*ids, "cell_key", "var", F.explode(F.filter(corners, lambda c: c["w"] != 0)).alias("_c"))
        .select(*ids, "cell_key", "var", "_c.doy", "_c.hres", F.col("_c.w").alias("_w"))
    )
    joined = exploded.join(surface, ["cell_key", "var", "doy", "hres"])
    return joined.groupBy(*ids).agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in DELTA_COLUMNS])


QM_POINTS = 101


def quantile_map(train: DataFrame, rows: DataFrame, points: int = QM_POINTS) -> DataFrame:
    """``mapped``: the truth value at the forecast's own rank in the cell's training days.

    Ranks are 101 evenly spaced levels with straight lines between them; values beyond the
    training range take its ends.
    """
    levels = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    maps = train.groupBy("cell_key").agg(F.percentile("hres", levels).alias("_qh"), F.percentile("era5", levels).alias("_qe"))
    joined = rows.join(maps, "cell_key").withColumn("_i", F.size(F.filter("_qh", lambda q: q <= F.col("hres"))))
    i = F.col("_i")
    h0, h1 = F.get("_qh", i - 1), F.get("_qh", i)
    e0, e1 = F.get("_qe", i - 1), F.get("_qe", i)
    mapped = (
        F.when(i == 0, F.col("_qe")[0])
        .when(i >= points, F.element_at("_qe", -1))
        .otherwise(e0 + (F.col("hres") - h0) / (h1 - h0) * (e1 - e0))
    )
    return joined.withColumn("mapped", mapped).drop("_qh", "_qe", "_i")


SURFACE_BINS = (0.2, 0.4, 0.6, 0.8)


def season_bin(doy: Column, parts: int = 8) -> Column:
    """The year in equal parts by day number."""
    return F.least(F.lit(parts - 1), F.floor((doy - 1) * parts / 366)).cast("int")


def fit_surface(train: DataFrame, static: DataFrame, min_n: int = 30) -> DataFrame:
    """Residual quantiles by cell, season part and forecast bin, with coarser fallbacks.

    A bin with fewer than ``min_n`` days takes the tile's quantiles, and a thin tile the
    global ones. ``static`` maps cells to tiles. Forecast bins are each cell's own quantiles.
    Cell groups are bounded by the calendar; tile and global pools are not and are selected
    without gathering them.
    """
    cell_edges = train.groupBy("cell_key").agg(F.percentile("hres", F.array(*[F.lit(q) for q in SURFACE_BINS])).alias("edges"))
    binned = (
        train.join(cell_edges, "cell_key")
        .join(static.select("cell_key", "tile_id"), "cell_key")
        .withColumn("part", season_bin(F.dayofyear("date")))
        .withColumn("bin", derive.search_bin(F.col("edges"), F.col("hres")))
    )
    levels = F.array(*[F.lit(p) for p in LEVELS])
    by_cell = binned.groupBy("cell_key", "tile_id", "part", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("bias", levels).alias("_qc")
    )
    by_tile = quantiles(binned, ["tile_id", "part", "bin"], "bias", LEVELS, "_qt").withColumnRenamed("n", "_nt")
    overall = quantiles(binned, [], "bias", LEVELS, "_qg").withColumnRenamed("n", "_ng")
    cells = cell_edges.join(static.select("cell_key", "tile_id"), "cell_key")
    frame = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(len(SURFACE_BINS))))
    )
    joined = (
        frame.join(by_cell, ["cell_key", "tile_id", "part", "bin"], "left")
        .join(by_tile, ["tile_id", "part", "bin"], "left")
        .join(F.broadcast(overall))
    )
    use_cell, use_tile = F.coalesce(F.col("n") >= min_n, F.lit(False)), F.coalesce(F.col("_nt") >= min_n, F.lit(False))
    chosen = F.when(use_cell, F.col("_qc")).when(use_tile, F.col("_qt")).otherwise(F.col("_qg"))
    grain = F.when(use_cell, "cell").when(use_tile, "tile").otherwise("global")
    return joined.select(
        "cell_key", "edges", "part", "bin", F.coalesce("n", F.lit(0)).alias("n"), grain.alias("grain"),
        *[chosen[i].alias(c) for i, c in enumerate(DELTA_COLUMNS)],
    )


def predict(rows: DataFrame, surface: DataFrame) -> DataFrame:
    """Nine residual heads per row from a fitted surface; rows carry ``doy`` and ``hres``."""
    edges = surface.select("cell_key", "edges").distinct()
    binned = (
        rows.join(edges, "cell_key")
        .withColumn("part", season_bin(F.col("doy")))
        .withColumn("bin", derive.search_bin(F.col("edges"), F.col("hres")))
        .drop("edges")
    )
    return binned.join(surface.drop("edges", "n", "grain"), ["cell_key", "part", "bin"])


def bake(surface: DataFrame, anchors: DataFrame, shifts: DataFrame, var: str) -> DataFrame:
    """A fitted surface on the lookup grid: shifted, rounded and monotone."""
    row = as_row(shifts).select(*[F.col(c).alias(f"_s_{c}") for c in DELTA_COLUMNS])
    predicted = sort_heads(predict(grid(anchors), surface)).join(F.broadcast(row))
    shifted = predicted.withColumns({c: F.col(c) + F.col(f"_s_{c}") for c in DELTA_COLUMNS})
    return pin_heads(shifted).select("cell_key", F.lit(var).alias("var"), "doy", "hres", *DELTA_COLUMNS)
