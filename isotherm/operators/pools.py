"""Comparison pools of a target day: ranks, tails, tiers and claims."""

from __future__ import annotations

import datetime as dt
from bisect import insort
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions import bands
from isotherm.operators.order_stats import tail_position
from isotherm.schemas import BAND_COLUMNS

# Parameters: the all-time list, the smallest pool that supports a claim, the window radius.
ALL_TIME = 10
CLAIM_POOL = 5
WINDOW_DAYS = 3


def rank_value(pool: DataFrame, targets: DataFrame, value: str, target: str, key: str = "cell_key") -> DataFrame:
    """Inclusive ranks of one target value per key within that key's pool.

    ``rank_high`` and ``rank_low`` count the days at least as extreme on either side, so
    ties share the last place of their group.
    """
    asked = targets.select(key, F.col(target).alias("_x"))
    counted = (
        pool.join(asked, key)
        .groupBy(key, "_x")
        .agg(
            F.count_if(F.col(value) >= F.col("_x")).alias("rank_high"),
            F.count_if(F.col(value) <= F.col("_x")).alias("rank_low"),
            F.count_if(F.col(value) > F.col("_x")).alias("above"),
            F.count(value).alias("total"),
        )
    )
    high = F.col("rank_high") <= F.col("rank_low")
    return counted.select(
        key, F.col("_x").alias(target), "rank_high", "rank_low", "above", "total",
        high.alias("high_side"),
        F.when(F.col("total") > 0, F.least("rank_high", "rank_low") / F.col("total")).otherwise(0.0).alias("single_tail"),
    )


def context_bucket(pct_above: Column, value: Column, metric: str) -> Column:
    """Seven buckets from extreme low to extreme high; a day without rain has its own."""
    below = 100 - pct_above
    bucket = (
        F.when(below <= 5, "extreme_low")
        .when(pct_above <= 5, "extreme_high")
        .when(below <= 10, "strong_low")
        .when(pct_above <= 10, "strong_high")
        .when(below <= 20, "mild_low")
        .when(pct_above <= 20, "mild_high")
        .otherwise("normal")
    )
    return F.when(value == 0, "driest").otherwise(bucket) if metric == "precip" else bucket


def sorted_pool(values: str) -> Column:
    """All finite values of a calendar-bounded pool in ascending order."""
    return F.array_sort(F.collect_list(F.when(~F.isnan(values), F.col(values))))


def tail_value(pool: Column, share: Column, high_side: Column) -> Column:
    """The order statistic that cuts off a tail share of a sorted array."""
    return F.get(pool, tail_position(F.size(pool), share, high_side))


def record_value(share: Column, high_side: Column) -> Column:
    """The record's tail cut at a share that reaches at most its listed extremes."""
    n = F.col("n_all")
    at = tail_position(n, share, high_side)
    return F.when(high_side, F.get("top", (n - 1 - at).cast("int"))).otherwise(F.get("bottom", at))


def _lists(rows: list[list[float]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(rows)), pa.float64()))


def _extremes_before(values: list[float], counts: np.ndarray, keep: int) -> tuple[list[list[float]], list[list[float]]]:
    """The ``keep`` largest, descending, and smallest, ascending, of the first ``n`` values for each of the rising ``counts``."""
    high: list[float] = []
    low: list[float] = []
    tops, bottoms, at = [], [], 0
    for n in counts.tolist():
        for v in values[at:n]:
            if len(high) < keep or v > high[0]:
                insort(high, v)
                del high[:-keep]
            if len(low) < keep or v < low[-1]:
                insort(low, v)
                del low[keep:]
        at = n
        tops.append(high[::-1])
        bottoms.append(low[:])
    return tops, bottoms


def _seasons_before(days: np.ndarray, values: list[float], asked: np.ndarray, counts: np.ndarray, radius: int) -> list[list[float]]:
    """Sorted values around each asked day's month and day in its own year, up to the day, and in all earlier years."""
    windows: list[list[float]] = [[]] * len(asked)
    if not len(days):
        return windows
    month_of = asked.astype("datetime64[M]")
    marks, mark = np.unique((month_of.astype(int) % 12) * 32 + (asked - month_of).astype(int), return_inverse=True)
    first, last = days[0].astype("datetime64[Y]").astype(int), days[-1].astype("datetime64[Y]").astype(int)
    years = np.arange(first, last + 1)
    # Feb 29 sits on Mar 1 in common years; a window ends with its year
    anchor = (years * 12 + (marks // 32)[:, None]).astype("datetime64[M]").astype("datetime64[D]") + (marks % 32)[:, None]
    starts, ends = (y.astype("datetime64[Y]").astype("datetime64[D]") for y in (years, years + 1))
    left = np.searchsorted(days, np.maximum(anchor - radius, starts), "left").tolist()
    right = np.searchsorted(days, np.minimum(anchor + radius, ends - 1), "right").tolist()
    own = (asked.astype("datetime64[Y]").astype(int) - first).tolist()
    pools: list[list[float]] = [[] for _ in marks]
    done = [0] * len(marks)
    for k, m in enumerate(mark.tolist()):
        year, pool = own[k], pools[m]
        while done[m] < min(year, len(years)):
            pool.extend(values[left[m][done[m]] : right[m][done[m]]])
            pool.sort()
            done[m] += 1
        here = values[left[m][year] : min(right[m][year], int(counts[k]))] if 0 <= year < len(years) else []
        windows[k] = sorted(pool + here)
    return windows


def history_pools(
    history: DataFrame, targets: DataFrame, value: str, radius: int = WINDOW_DAYS, keep: int = ALL_TIME + 1, carried: Sequence[str] = ()
) -> DataFrame:
    """What each target day had before it: the season's window and the whole record.

    ``window`` holds the values of the days within ``radius`` of the target's month and day
    in its own and every earlier year, ``n_all`` counts all earlier days, and ``top``/``bottom`` are the
    most extreme ``keep`` of them. Targets need ``cell_key`` and ``date``; the result has one row per target, and with
    ``carried`` columns one per row of ``targets``. One shuffle brings a cell's days together, which the calendar bounds;
    they are walked in their order, so nothing larger than a pool is kept for a target.
    """
    rows = targets.select("cell_key", "date", *carried)
    rows = rows if carried else rows.distinct()
    known = history.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col("cell_key").isNotNull() & F.col("date").isNotNull())
    days = known.select("cell_key", "date", F.col(value).cast("double").alias("_v"), F.lit(False).alias("_target"))
    both = rows.withColumn("_target", F.lit(True)).unionByName(days, allowMissingColumns=True)

    def walk(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("date")
        asked, past = cell.filter(cell["_target"]), cell.filter(pc.invert(cell["_target"]))
        dates, wanted = (t["date"].fill_null(dt.date(1, 1, 1)).to_numpy().astype("datetime64[D]") for t in (past, asked))
        # a target without a date comes last in the table and has nothing before it
        order = np.argsort(wanted, kind="stable")
        asked, wanted, values = asked.take(order), wanted[order], past["_v"].to_pylist()
        counts = np.searchsorted(dates, wanted, "left")
        tops, bottoms = _extremes_before(values, counts, keep)
        out = asked.select(["cell_key", "date", *carried]).append_column("n_all", pa.array(counts, pa.int64()))
        out = out.append_column("top", _lists(tops)).append_column("bottom", _lists(bottoms))
        return out.append_column("window", _lists(_seasons_before(dates, values, wanted, counts, radius)))

    lists = ", ".join(f"{c} array<double>" for c in ("top", "bottom", "window"))
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return both.groupBy("cell_key").applyInArrow(walk, f"{given}, n_all bigint, {lists}")


def resolve_tier(df: DataFrame, estimate: Column, bucketed: bool) -> DataFrame:
    """The verdict tier of an estimate against its pools, and the value it is pinned to.

    Needs ``window`` (ascending), ``n_all``, ``top`` (descending) and ``bottom`` (ascending).
    A null tier means the window is empty.
    """
    x = estimate
    window, n_all = F.col("window"), F.col("n_all")
    n = F.size(window)
    with_ranks = df.withColumns(
        {
            "n_win": n,
            "rank_high": F.size(F.filter(window, lambda v: v >= x)),
            "rank_low": F.size(F.filter(window, lambda v: v <= x)),
            "_ah": F.size(F.filter("top", lambda v: v >= x)),
            "_al": F.size(F.filter("bottom", lambda v: v <= x)),
        }
    ).withColumn("high_side", F.col("rank_high") <= F.col("rank_low"))
    high = F.col("high_side")
    rank = F.when(high, F.col("rank_high")).otherwise(F.col("rank_low"))
    # without a window there is no share, and no tier
    days = F.nullif(F.col("n_win"), F.lit(0))
    tail = rank / days
    # the lists hold eleven days, so eleven hits mean "more than ten"
    all_time = F.when(high, F.col("_ah")).otherwise(F.col("_al"))
    ranked = with_ranks.withColumn("rank", rank).withColumn("single_tail", tail).withColumn("_at", all_time)
    position = F.col("rank_low") / days
    mild = F.when((position >= 0.4) & (position <= 0.6), "mildDead").otherwise("mildOff")
    ladder = F.when((F.col("_at") >= 1) & (F.col("_at") <= ALL_TIME), "alltime")
    if not bucketed:
        ladder = ladder.when(F.col("rank") <= 5, "top5")
    ladder = ladder.when(F.col("single_tail") <= 0.05, "extreme")
    if bucketed:
        ladder = ladder.when(F.col("single_tail") <= 0.1, "mid")
    tier = F.when(F.col("n_win") > 0, ladder.when(F.col("single_tail") <= 0.2, "notable").otherwise(mild))
    tiered = ranked.withColumn("tier", tier)
    cutoff = (
        F.when(F.col("tier") == "alltime", F.lit(float(ALL_TIME)) / F.greatest(F.lit(1), n_all))
        .when(F.col("tier") == "top5", F.least(F.lit(0.5), F.lit(5.0) / F.greatest(F.lit(1), F.col("n_win"))))
        .when(F.col("tier") == "extreme", 0.05)
        .when(F.col("tier") == "mid", 0.1)
        .when(F.col("tier").isNotNull(), 0.2)
    )
    tiered = tiered.withColumn("cutoff", cutoff).withColumn("two_sided", F.col("tier").isin("mildOff", "mildDead"))
    middle = (F.get(window, F.floor((n - 1) / 2).cast("int")) + F.get(window, F.ceil((n - 1) / 2).cast("int"))) / 2
    pinned = (
        F.when(F.col("tier") == "alltime", record_value(F.col("cutoff"), high))
        .when(F.col("tier") == "mildDead", middle)
        .when(F.col("tier") == "mildOff", tail_value(window, F.lit(0.3), high))
        .when(F.col("tier").isNotNull(), tail_value(window, F.col("cutoff"), high))
    )
    return tiered.withColumn("reference", pinned).drop("_ah", "_al", "_at")


def card_claims(df: DataFrame, truth: Column, estimate: Column, heads: Sequence[str] = BAND_COLUMNS) -> DataFrame:
    """The claimed chance, the figure shown and whether the day kept the claim.

    Pools under five days support no claim. ``df`` carries the pools and the band columns.
    """
    tiered = resolve_tier(df, estimate, bucketed=True)
    window, high = F.col("window"), F.col("high_side")
    all_time = F.col("tier") == "alltime"
    record_cut = record_value(F.col("cutoff"), high)
    marked = tiered.withColumns(
        {
            "_lo": tail_value(window, F.col("cutoff"), F.lit(False)),
            "_hi": tail_value(window, F.col("cutoff"), F.lit(True)),
            "_one": F.when(all_time, record_cut).otherwise(tail_value(window, F.col("cutoff"), high)),
        }
    )
    points = [F.col(h) for h in heads]
    chance = F.when(F.col("two_sided"), bands.prob_interval(points, F.col("_lo"), F.col("_hi"))).otherwise(
        bands.prob_beyond(points, F.col("_one"), high)
    )
    kept = F.when(F.col("two_sided"), (F.col("_lo") <= truth) & (truth <= F.col("_hi"))).otherwise(
        F.when(high, truth >= F.col("_one")).otherwise(truth <= F.col("_one"))
    )
    enough = F.col("n_win") >= CLAIM_POOL
    claimed = marked.withColumn("claimed_p", F.when(enough, chance)).withColumn("hit", F.when(enough, kept.cast("int")))
    shown = F.least(F.lit(95), F.floor(F.col("claimed_p") * 20 + 0.5) * 5).cast("int")
    return claimed.withColumn("displayed", shown).withColumn("tier", F.when(enough, F.col("tier"))).drop("_lo", "_hi", "_one")


def band_tail_range(df: DataFrame, lo: Column, hi: Column, high_side: Column) -> DataFrame:
    """Tail shares of a band's two ends in the window, in percent: near and far end.

    Both are null once the far end reaches past the middle of the pool.
    """
    window = F.col("window")
    n = F.greatest(F.lit(1), F.size(window))

    def share(x: Column) -> Column:
        high = F.size(F.filter(window, lambda v: v >= x))
        low = F.size(F.filter(window, lambda v: v <= x))
        return F.when(high_side, high).otherwise(low) / n * 100

    ends = df.withColumn("_a", share(lo)).withColumn("_b", share(hi))
    # an end past every day on record takes the rarest place the pool can resolve
    near, far = F.greatest(F.least("_a", "_b"), 100 / n), F.greatest("_a", "_b")
    return ends.withColumn("near_pct", F.when(far <= 50, near)).withColumn("far_pct", F.when(far <= 50, far)).drop("_a", "_b")
