"""Nine-point predictive bands: clamps, cumulative probability and its inverse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from isotherm.schemas import LEVELS, TRACE_MM

MEDIAN = LEVELS.index(0.50)
# Fixed value: share of the median-to-tenth step at which the quarter points lie.
PROBIT_SHOULDER = 0.526307
INF = float("inf")


def trace_clamp(value: Column, metric: str | None = "precip") -> Column:
    """Rain below the trace threshold is none; null stays null."""
    if metric != "precip":
        return value
    return F.when(value < TRACE_MM, F.lit(0.0)).otherwise(value)


def prob_interval(points: Sequence[Column], lo: Column, hi: Column, levels: Sequence[float] = LEVELS) -> Column:
    """Probability mass of the piecewise-linear distribution inside [lo, hi].

    A flat segment is a point mass; the mass beyond either end sits on that end.
    """
    first, last = points[0], points[-1]

    def mass_if(cond: Column, mass: float) -> Column:
        return F.when(cond, F.lit(mass)).otherwise(F.lit(0.0))

    parts = [
        mass_if((lo <= first) & (first <= hi), levels[0]),
        mass_if((lo <= last) & (last <= hi), 1 - levels[-1]),
    ]
    for a, b, p, q in zip(points, points[1:], levels, levels[1:]):
        inside = F.least(F.greatest(hi, a), b) - F.least(F.greatest(lo, a), b)
        parts.append(
            F.when(b == a, mass_if((lo <= a) & (a <= hi), q - p)).otherwise(F.lit(q - p) * (inside / (b - a)))
        )
    total = reduce(lambda x, y: x + y, parts)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def prob_beyond(points: Sequence[Column], threshold: Column, high_side: Column) -> Column:
    """Probability of staying on the claimed side of a threshold."""
    return F.when(high_side, prob_interval(points, threshold, F.lit(INF))).otherwise(
        prob_interval(points, F.lit(-INF), threshold)
    )


def inverse_cdf(points: Sequence[Column], u: Column, levels: Sequence[float] = LEVELS) -> Column:
    """Value at cumulative probability ``u``, clamped to the two ends."""
    out = F.when(u <= levels[0], points[0])
    for a, b, p, q in zip(points, points[1:], levels, levels[1:]):
        out = out.when(u <= q, a + (u - F.lit(p)) / F.lit(q - p) * (b - a))
    return out.otherwise(points[-1])


def pin_median(heads: Sequence[Column], median: int = MEDIAN) -> list[Column]:
    """Monotone heads around an unmoved median: running maximum above, minimum below."""
    out: list[Column] = list(heads)
    for j in range(len(heads)):
        if j > median:
            out[j] = F.greatest(*heads[median : j + 1])
        elif j < median:
            out[j] = F.least(*heads[j : median + 1])
    return out


def shoulders(q10: Column, mid: Column, q90: Column, how: str = "probit") -> tuple[Column, Column]:
    """Quarter points from the tenth, median and ninetieth heads."""
    weight = PROBIT_SHOULDER if how == "probit" else 0.625
    return mid - weight * (mid - q10), mid + weight * (q90 - mid)


def crosses(heads: Sequence[Column]) -> Column:
    """True where any head lies below its left neighbour."""
    return reduce(lambda x, y: x | y, [b < a for a, b in zip(heads, heads[1:])])
