"""Calendar columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(column: Column) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(column, "MM")


def month_label(column: Column) -> Column:
    """``Jan 2017`` style label."""
    return F.date_format(column, "MMM yyyy")


def whole_days(earlier: Column, later: Column) -> Column:
    """Complete 24-hour periods between two timestamps."""
    return F.date_part(F.lit("DAY"), later - earlier).cast("int")


def fractional_days(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def date_between(column: Column, start: dt.date, end: dt.date) -> Column:
    """Half-open range ``[start, end)``."""
    return (column >= F.lit(start)) & (column < F.lit(end))
