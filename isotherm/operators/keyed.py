"""Small building blocks shared by many operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the largest by ``order``, as a partial aggregate.

    Unlike a window it is combined before the shuffle, so a key that holds most of the
    rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def flag(cond: Column) -> Column:
    """A condition as 1.0 / 0.0, null where it is null."""
    return cond.cast("double")


def share(cond: Column) -> Column:
    """Share of rows that meet a condition, over rows where it is known."""
    return F.avg(flag(cond))
