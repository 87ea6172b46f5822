"""Calendar rules: seasonal anchors, the 365-day circle, seasons and phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCLE_DAYS = 365
WEEKS = 52
_MONTH_START_OFFSET = 1


def anchor(year: Column, month: Column | int, day: Column | int) -> Column:
    """Day ``day`` of a month in ``year``; Feb 29 rolls to Mar 1 in a common year."""
    month = F.lit(month) if isinstance(month, int) else month
    day = F.lit(day) if isinstance(day, int) else day
    return F.date_add(F.make_date(year, month, F.lit(_MONTH_START_OFFSET)), day - 1)


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def circle_doy(date: Column) -> Column:
    """Day index 0..364; a leap year is squeezed onto the same circle."""
    return F.floor((F.dayofyear(date) - 1) / days_in_year(F.year(date)) * CIRCLE_DAYS).cast("int")


def circle_week(date: Column) -> Column:
    """Week 0..51 of the circle; the last one takes the left-over days."""
    return F.least(F.lit(WEEKS - 1), F.floor(circle_doy(date) / 7)).cast("int")


def phase(date: Column) -> tuple[Column, Column]:
    """Cosine and sine of the raw day of the year over a 365.25-day period."""
    angle = F.dayofyear(date) * F.lit(2.0) * F.pi() / F.lit(365.25)
    return F.cos(angle), F.sin(angle)


def calendar_season(date: Column) -> Column:
    """DJF / MAM / JJA / SON by calendar month."""
    names = F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")])
    return F.element_at(names, (F.floor((F.month(date) % 12) / 3) + 1).cast("int"))


def local_season(date: Column, lat: Column) -> Column:
    """Winter .. Autumn as people there live it; the southern months shift by six."""
    month = F.when(lat >= 0, F.month(date)).otherwise((F.month(date) + 5) % 12 + 1)
    names = F.array(*[F.lit(s) for s in ("Winter", "Spring", "Summer", "Autumn")])
    return F.element_at(names, (F.floor((month % 12) / 3) + 1).cast("int"))


def local_winter(date: Column, lat: Column) -> Column:
    month = F.month(date)
    return F.when(lat >= 0, month.isin(12, 1, 2)).otherwise(month.isin(6, 7, 8))


def in_season(date: Column, month: int | Column, day: int | Column, radius: int) -> Column:
    """Within ``radius`` days of the target month and day, in the row's own year.

    The window does not wrap at New Year: a Jan 1 target never reaches December.
    """
    centre = anchor(F.year(date), month, day)
    return date.between(F.date_sub(centre, radius), F.date_add(centre, radius))


def month_block(date: Column, origin: Column) -> Column:
    """Months since the origin's month."""
    return (F.year(date) - F.year(origin)) * 12 + (F.month(date) - F.month(origin))
