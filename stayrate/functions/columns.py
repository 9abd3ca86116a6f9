"""Scalar column expressions with one meaning on every engine."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Round half up through a decimal, so binary noise near a tie cannot flip the last digit."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL where the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean_where(condition: Column, value: Column) -> Column:
    """Mean over the rows that meet a condition, as exact sum over count."""
    kept = F.when(condition, value)
    return ratio(F.sum(kept), F.count(kept))


def mean_of(value: Column) -> Column:
    return ratio(F.sum(value), F.count(value))


def complete_months(start: Column, end: Column) -> Column:
    """Number of whole months from start to end (Jan 31 to Feb 29 is 0)."""
    return F.timestamp_diff("MONTH", start, end).cast("int")


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def month_start_from(day: Column) -> Column:
    """The first day-of-month that is not before the given day."""
    return F.trunc(F.date_add(F.last_day(F.date_sub(day, 1)), 1), "month")


def days_before(as_of: date, days: int) -> Column:
    return F.lit(as_of - timedelta(days=days))


def flag(condition: Column) -> Column:
    """0/1 with NULL conditions counted as 0."""
    return F.when(condition, 1).otherwise(0)


def stable_bits(seed: int, *parts: Column) -> Column:
    """52 uniform bits from an md5 of the parts: the same on every retry and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def stable_unit(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the same bits."""
    return stable_bits(seed, *parts) / F.lit(float(1 << 52))


def magnitude_bucket(value: Column, steps_per_octave: int = 256, unit: float = 1e6) -> Column:
    """Order-preserving bucket number with relative width.

    At most 2 * steps * log2(range * unit) buckets exist (about 20,000 for values up to 1e6), and one
    bucket holds few distinct fixed-point values: both levels of a two-level ranking stay small without
    looking at the data first.
    """
    size = F.floor(F.log2(F.abs(value.cast("double")) * unit + 1.0) * steps_per_octave)
    return (F.signum(value.cast("double")) * size).cast("int")
