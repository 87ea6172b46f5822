"""Row numbers, running sums and equal-count parts over a whole table, exact and without one task that sees it all.

A scan in two levels: the rows are dealt into sorted ranges of the whole order (not only of its first column, so equal
values are split as any others), each range is added up, the sums of the ranges before are the offsets of a range, and
inside a range a window does the rest. The ranges are a written table: both passes must see the same borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isotherm.session import materialize

NUMBER = "row_number"


def ranges(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` as a written table with ``_part``, which rises with the order. Rows equal in all columns share a part."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    dealt = df.withColumn("_tie", tie).repartitionByRange(parts, *order, F.col("_tie"))
    return materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def scan(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``row_number`` (from 1), ``rows`` (of the table) and, for each name in ``sums``, the running sum ``name`` up to
    and with the row and the total ``name_total``."""
    sums = dict(sums or {})
    dealt = ranges(df.withColumns({f"_s_{k}": v for k, v in sums.items()}), order, parts)
    added = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"), *[F.sum(f"_s_{k}").alias(f"_m_{k}") for k in sums])
    # one row per range: a window over all of them is as small as their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = added.select(
        "_part", F.coalesce(F.sum("_m").over(before), zero).alias("_o"), F.sum("_m").over(whole).alias("rows"),
        *[c for k in sums for c in (F.coalesce(F.sum(f"_m_{k}").over(before), zero).alias(f"_o_{k}"), F.sum(f"_m_{k}").over(whole).alias(f"{k}_total"))],
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie")))
    numbered = numbered.withColumns({f"_r_{k}": F.sum(f"_s_{k}").over(inside) for k in sums}).join(F.broadcast(offsets), "_part")
    return numbered.select(
        *df.columns, (F.col("_o") + F.col("_i")).alias(NUMBER), "rows",
        *[c for k in sums for c in ((F.col(f"_o_{k}") + F.col(f"_r_{k}")).alias(k), F.col(f"{k}_total"))],
    )


def equal_counts(df: DataFrame, order: Sequence[Column], count: int, name: str) -> DataFrame:
    """``name``: which of ``count`` equal shares of the ordered rows a row is in, from 1; the first shares hold the rows left over, as ``ntile`` has it."""
    numbered = scan(df, order)
    n, i = F.col("rows"), F.col(NUMBER) - 1
    small, extra = F.floor(n / count), n % count
    large = extra * (small + 1)
    share = F.when(i < large, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - large) / F.greatest(small, F.lit(1))))
    return numbered.withColumn(name, (share + 1).cast("int")).drop(NUMBER, "rows")
