"""Exact order statistics and ranks over pools of any size.

``percentile`` keeps a value -> count map per group, which is right for the pools the calendar bounds (one cell, one
season). A pool over the whole table is not bounded, so here equal values are counted first (a value that holds a third
of the rows becomes one row). A rank is then located in two histograms: slots that grow with the size of the value, so
that no outlier can push all others into one, and equal parts between the smallest and largest value of the slot that
holds the rank. Only the distinct values of that part are ordered. The path is the same for every size, and nothing
runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: slots per e-fold of the value; together at most about 93,000 for all doubles, a few thousand for measured values
FOLD_SLOTS = 64
#: values below this size share the slots around zero
FINEST = 2.0**-20
#: equal parts of a slot
PARTS = 4096


def _value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``_k, _v, _c``: distinct values and their counts. The keys are one struct, in which nulls are equal."""
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("_all"))
    pool = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key.alias("_k"), (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    return pool.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))


def _slot(value: Column) -> Column:
    """Rises with the value."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) / FINEST) * FOLD_SLOTS)


def _part(value: Column, low: Column, high: Column) -> Column:
    """Rises with the value between the ends of its slot."""
    width = high - low
    at = F.floor((value - low) / width * PARTS)
    return F.when((width > 0) & (width < float("inf")), F.least(F.lit(PARTS - 1).cast("long"), at)).otherwise(F.lit(0).cast("long"))


def _before(by: Sequence[str], order: str, count: str) -> Column:
    """How many rows of the group come earlier."""
    return F.coalesce(F.sum(count).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holds(start: str, count: str) -> Column:
    return (F.col("_pos") >= F.col(start)) & (F.col("_pos") < F.col(start) + F.col(count))


def _at_positions(counted: DataFrame, positions: Callable[[Column], Column]) -> DataFrame:
    """``_k, n, i, v`` for each wanted position of each group of ``_value_counts``."""
    slotted = counted.withColumn("_slot", _slot(F.col("_v")))
    slots = slotted.groupBy("_k", "_slot").agg(F.sum("_c").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    placed = slots.withColumn("_start", _before(["_k"], "_slot", "_m")).withColumn("n", F.sum("_m").over(Window.partitionBy("_k")))
    in_slot = placed.select("*", F.posexplode(positions(F.col("n"))).alias("i", "_pos")).where(_holds("_start", "_m"))

    ends = in_slot.select("_k", "_slot", "_low", "_high").distinct()
    cut = slotted.join(ends, ["_k", "_slot"]).select("_k", "_slot", _part(F.col("_v"), F.col("_low"), F.col("_high")).alias("_part"), "_v", "_c")
    parts = cut.groupBy("_k", "_slot", "_part").agg(F.sum("_c").alias("_pm")).withColumn("_within", _before(["_k", "_slot"], "_part", "_pm"))
    shifted = in_slot.select("_k", "_slot", "n", "i", (F.col("_pos") - F.col("_start")).alias("_pos"))
    in_part = shifted.join(parts, ["_k", "_slot"]).where(_holds("_within", "_pm"))
    rest = in_part.select("_k", "_slot", "_part", "n", "i", (F.col("_pos") - F.col("_within")).alias("_pos"))

    wanted = rest.groupBy("_k", "_slot", "_part", "n").agg(F.collect_list(F.struct("i", "_pos")).alias("_wanted"))
    ordered = cut.join(wanted, ["_k", "_slot", "_part"]).withColumn("_skip", _before(["_k", "_slot", "_part"], "_v", "_c"))
    found = F.filter("_wanted", lambda w: (w["_pos"] >= F.col("_skip")) & (w["_pos"] < F.col("_skip") + F.col("_c")))
    return ordered.select("_k", "n", F.explode(found).alias("_w"), F.col("_v").alias("v")).select("_k", "n", F.col("_w.i").alias("i"), "v")


def _with_keys(found: DataFrame, keys: Sequence[str], *columns: str | Column) -> DataFrame:
    return found.select(*[F.col("_k").getField(k).alias(k) for k in keys], *columns)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, positions: Callable[[Column], Column]) -> DataFrame:
    """Values at given 0-based positions of each group's sorted values.

    ``positions`` maps the group's count to an array of positions; there the group's keys are fields of ``_k``, for
    positions that depend on them. The result has the
    keys, ``n``, ``i`` (index into the array) and ``v``. Null and NaN values take no part; a null key is a group.
    """
    return _with_keys(_at_positions(_value_counts(df, keys, value), positions), keys, "n", "i", "v")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """Linear-interpolation quantiles, exact: keys, ``n`` and an array column ``name``."""

    def neighbours(n: Column) -> Column:
        wanted = []
        for p in probs:
            at = (n - 1) * F.lit(float(p))
            wanted += [F.floor(at).cast("long"), F.ceil(at).cast("long")]
        return F.array(*wanted)

    found = _at_positions(_value_counts(df, keys, value), neighbours)
    pairs = found.groupBy("_k", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("_m"))
    values = []
    for j, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.element_at("_m", F.lit(2 * j)), F.element_at("_m", F.lit(2 * j + 1))
        values.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))))
    return _with_keys(pairs, keys, "n", F.array(*values).alias(name))


#: weights are added up as whole parts of this size, so their sums are exact in any order
WEIGHT_UNIT = 1e-6


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: Column, probs: Sequence[float], name: str = "q") -> DataFrame:
    """Quantiles by cumulative weight, exact: keys, ``n`` (the weight in units of WEIGHT_UNIT) and an array column ``name``.

    The quantile of p is the smallest value up to which at least p of the weight lies. Weights are rounded to the unit;
    rows without weight take no part.
    """
    units = F.floor(weight * F.lit(1 / WEIGHT_UNIT) + 0.5).cast("long")
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("_all"))
    pool = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key.alias("_k"), (F.col(value).cast("double") + F.lit(0.0)).alias("_v"), units.alias("_w")).where("_w > 0")
    counted = pool.groupBy("_k", "_v").agg(F.sum("_w").alias("_c"))
    wanted = lambda n: F.array(*[F.greatest(F.ceil(n * F.lit(float(p))) - 1, F.lit(0)).cast("long") for p in probs])
    found = _at_positions(counted, wanted).groupBy("_k", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("_m"))
    return _with_keys(found, keys, "n", F.array(*[F.element_at("_m", F.lit(j)) for j in range(len(probs))]).alias(name))


def conformal_position(n: Column, level: float) -> Column:
    """0-based position of the one-sided finite-sample rank for a level."""
    if level > 0.5:
        rank = F.least(F.ceil((n + 1) * F.lit(level)), n)
    else:
        rank = F.greatest(F.floor((n + 1) * F.lit(level)), F.lit(1))
    return (rank - 1).cast("long")


def tail_position(n: Column, share: Column, high_side: Column) -> Column:
    """0-based position of the order statistic that cuts off a tail share."""
    high = F.floor((F.lit(1.0) - share) * n)
    low = F.ceil(share * n) - 1
    return F.greatest(F.lit(0), F.least(n - 1, F.when(high_side, high).otherwise(low))).cast("int")


def global_row_number(df: DataFrame, bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Row number over the whole table without sorting it in one task.

    ``bucket`` must rise with the order; rows are numbered inside their bucket and shifted
    by the number of rows in the buckets before it.
    """
    marked = df.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, so this window is as small as the bucket expression makes it
    starts = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_m")).select(
        "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_b").orderBy(*order)
    return (
        marked.withColumn("_rn", F.row_number().over(inside))
        .join(starts, "_b")
        .withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_b", "_rn", "_start")
    )


def average_rank_share(value: str, group: Sequence[str]) -> Column:
    """Average-method percentile rank: ties share the mean of their ranks."""
    # ordered by value alone, so equal values are peers and rank() gives the first of them
    ordered = Window.partitionBy(*group).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    total = F.count(value).over(Window.partitionBy(*group))
    share = (F.rank().over(ordered) + (ties - 1) / 2) / total
    return F.when(F.col(value).isNotNull(), share)
