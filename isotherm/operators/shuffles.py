"""Year-shuffle tests: is the difference between two periods unusual?

Whole years are dealt into two piles of the observed sizes, many times. The deal is the
order of md5 over seed, permutation number and year, so a result can be repeated by any
engine. One task handles one cell's record, which the calendar bounds; within it the deals
are a matrix and the order statistics of all of them come from one sorted pass.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions import calendar

MIN_WEEKS = 8
MIN_YEARS = 2
TOLERANCE = 1e-12
DEAL_BLOCK = 500


def deal_years(years: list[int], early_size: int, deals: int, seed: int) -> np.ndarray:
    """Boolean matrix deals x years: True where the year falls into the early pile."""
    out = np.zeros((deals, len(years)), dtype=bool)
    for p in range(deals):
        digests = [hashlib.md5(f"{seed}:{p}:{y}".encode()).hexdigest() for y in years]
        out[p, sorted(range(len(years)), key=digests.__getitem__)[:early_size]] = True
    return out


@lru_cache(maxsize=64)
def distinct_deals(years: tuple[int, ...], early_size: int, deals: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The different piles among the deals and how often each was dealt.

    They depend on the years alone, so a worker makes them once for all cells with the same years.
    """
    return np.unique(deal_years(list(years), early_size, deals, seed), axis=0, return_counts=True)


def _quantile_of_members(values: np.ndarray, member: np.ndarray, q: float) -> np.ndarray:
    """Per row of ``member``, the interpolated quantile of the sorted values it selects."""
    seen = np.cumsum(member, axis=1, dtype=np.int32)
    size = seen[:, -1]
    at = (size - 1) * q
    low = np.floor(at).astype(np.int64)
    first = values[(seen >= (low + 1)[:, None]).argmax(axis=1)]
    second = values[(seen >= np.minimum(low + 2, np.maximum(size, 1))[:, None]).argmax(axis=1)]
    return np.where(size > 0, first + (second - first) * (at - low), np.nan)


def _gaps(groups: list[tuple[np.ndarray, np.ndarray]], early: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean signed and mean absolute late-minus-early gap per deal over the groups."""
    signed, absolute, count = (np.zeros(len(early)) for _ in range(3))
    for values, owner in groups:
        member = early[:, owner]
        gap = _quantile_of_members(values, ~member, q) - _quantile_of_members(values, member, q)
        known = ~np.isnan(gap)
        signed[known] += gap[known]
        absolute[known] += np.abs(gap[known])
        count += known
    with np.errstate(invalid="ignore", divide="ignore"):
        return signed / count, absolute / count


def _sorted_groups(frame: pd.DataFrame, years: list[int], by: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    position = {y: i for i, y in enumerate(years)}
    parts = [frame] if by is None else [part for _, part in frame.groupby(by, sort=True)]
    groups = []
    for part in parts:
        values = part["value"].to_numpy(dtype=float)
        owner = part["year"].map(position).to_numpy()
        order = np.argsort(values, kind="stable")
        groups.append((values[order], owner[order]))
    return groups


def _shuffle(frame: pd.DataFrame, by: str | None, q: float, deals: int, seed: int) -> dict | None:
    """Observed gaps and the counts of deals at least as extreme; None when untestable."""
    early_years = sorted(frame.loc[frame["early"], "year"].unique())
    late_years = sorted(frame.loc[~frame["early"], "year"].unique())
    years = [int(y) for y in [*early_years, *late_years]]
    groups = _sorted_groups(frame, years, by)
    observed = np.zeros((1, len(years)), dtype=bool)
    observed[0, : len(early_years)] = True
    usable = [g for g in groups if not np.isnan(_gaps([g], observed, q)[0][0])]
    if not usable:
        return None
    signed, absolute = (float(x[0]) for x in _gaps(usable, observed, q))
    dealt, times = distinct_deals(tuple(years), len(early_years), deals, seed)
    count_signed = count_abs = 0
    null_abs = 0.0
    for start in range(0, len(dealt), DEAL_BLOCK):
        s, a = _gaps(usable, dealt[start : start + DEAL_BLOCK], q)
        known = ~np.isnan(s)
        often = times[start : start + DEAL_BLOCK][known]
        count_signed += int(often[np.abs(s[known]) >= abs(signed) - TOLERANCE].sum())
        count_abs += int(often[a[known] >= absolute - TOLERANCE].sum())
        null_abs += float((a[known] * often).sum())
    return {
        "groups": len(usable),
        "early_years": len(early_years),
        "late_years": len(late_years),
        "signed_gap": signed,
        "abs_gap": absolute,
        "count_signed": count_signed,
        "count_abs": count_abs,
        "p_signed": (count_signed + 1) / (deals + 1),
        "p_abs": (count_abs + 1) / (deals + 1),
        "null_abs_gap": null_abs / deals,
    }


RESULT = (
    "cell_key STRING, groups INT, early_years INT, late_years INT, signed_gap DOUBLE, abs_gap DOUBLE, count_signed INT, "
    "count_abs INT, p_signed DOUBLE, p_abs DOUBLE, null_abs_gap DOUBLE"
)


def _samples(rows: DataFrame, value: str, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    year = F.year("date")
    return rows.where(
        F.col(value).isNotNull() & ~F.isnan(value) & (year.between(*early) | year.between(*late))
    ).select(
        "cell_key", year.alias("year"), calendar.circle_week(F.col("date")).alias("week"), F.col(value).alias("value"), year.between(*early).alias("early")
    )


def week_shuffle_test(rows: DataFrame, value: str, early: tuple[int, int], late: tuple[int, int], q: float = 0.5, deals: int = 2000, seed: int = 42) -> DataFrame:
    """Per cell: weekly statistics of two periods against random deals of the years.

    Cells with fewer than two years on a side or eight comparable weeks have no row.
    """

    def one_cell(frame: pd.DataFrame) -> pd.DataFrame:
        enough = frame.groupby("early")["year"].nunique()
        if len(enough) == 2 and enough.min() >= MIN_YEARS:
            result = _shuffle(frame, "week", q, deals, seed)
            if result and result["groups"] >= MIN_WEEKS:
                return pd.DataFrame([{"cell_key": frame["cell_key"].iloc[0], **result}])
        return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])

    return _samples(rows, value, early, late).groupBy("cell_key").applyInPandas(one_cell, RESULT)


def year_block_test(rows: DataFrame, value: str, old: tuple[int, int], new: tuple[int, int], q: float = 0.5, deals: int = 10_000, seed: int = 42) -> DataFrame:
    """Per cell: difference of the pooled statistic between two periods, with its p-value."""

    def one_cell(frame: pd.DataFrame) -> pd.DataFrame:
        result = _shuffle(frame, None, q, deals, seed) if frame["early"].nunique() == 2 else None
        if result is None:
            return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])
        return pd.DataFrame([{"cell_key": frame["cell_key"].iloc[0], **result}])

    tested = _samples(rows, value, old, new).groupBy("cell_key").applyInPandas(one_cell, RESULT)
    return tested.select(
        "cell_key", F.col("signed_gap").alias("observed_diff"), F.col("p_signed").alias("p"),
        F.col("early_years").alias("old_years"), F.col("late_years").alias("new_years"),
    )


def weekly_gap(rows: DataFrame, value: str, early: tuple[int, int], late: tuple[int, int], q: float = 0.5) -> DataFrame:
    """Per cell: mean signed and absolute weekly gap and the mean position of the late
    statistic among the early days, ties counting half."""
    samples = _samples(rows, value, early, late)
    years = samples.groupBy("cell_key").agg(
        F.count_distinct(F.when(F.col("early"), F.col("year"))).alias("_ey"), F.count_distinct(F.when(~F.col("early"), F.col("year"))).alias("_ly")
    ).where((F.col("_ey") >= MIN_YEARS) & (F.col("_ly") >= MIN_YEARS))
    stat = F.percentile("value", F.lit(q))
    halves = samples.groupBy("cell_key", "week").pivot("early", [True, False]).agg(stat)
    weeks = halves.where(F.col("true").isNotNull() & F.col("false").isNotNull()).select(
        "cell_key", "week", F.col("true").alias("early_stat"), F.col("false").alias("late_stat")
    )
    place = F.when(F.col("value") < F.col("late_stat"), 1.0).when(F.col("value") == F.col("late_stat"), 0.5).otherwise(0.0)
    ranked = samples.where("early").join(weeks, ["cell_key", "week"]).groupBy("cell_key", "week", "early_stat", "late_stat").agg(
        (F.avg(place) * 100).alias("_pct")
    )
    gap = F.col("late_stat") - F.col("early_stat")
    cells = ranked.groupBy("cell_key").agg(
        F.count(F.lit(1)).alias("weeks"), F.avg(gap).alias("signed_gap"), F.avg(F.abs(gap)).alias("abs_gap"), F.avg("_pct").alias("percentile")
    )
    return cells.where(F.col("weeks") >= MIN_WEEKS).join(years.select("cell_key"), "cell_key", "left_semi")


def significance(p: Column, difference: Column) -> tuple[Column, Column]:
    """Tier of a p-value and, where it is significant, the direction of change."""
    tier = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    direction = F.when(p < 0.05, F.when(difference >= 0, "up").otherwise("down"))
    return tier, direction
