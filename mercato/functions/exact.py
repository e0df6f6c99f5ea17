"""Arithmetic on decimals.

Money and ratios never pass through doubles, so rounding is half away from
zero and a threshold compares the true quotient.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Two operands of this type divide into decimal(38,14).
OPERAND = "decimal(24,4)"
MONEY = "decimal(22,2)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 14 fractional digits; NULL when the denominator is 0."""
    divisor = F.nullif(denominator.cast(OPERAND), F.lit(0).cast(OPERAND))
    return numerator.cast(OPERAND) / divisor


def percent(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``100 * numerator / denominator``, multiplied before it is divided."""
    return F.round(ratio(numerator * 100, denominator), digits).cast(f"decimal(18,{digits})")


def mean(column: Column) -> Column:
    """Mean of the non-NULL values as decimal(20,14)."""
    return ratio(F.sum(column), F.count(column)).cast("decimal(20,14)")


def money_mean(column: Column) -> Column:
    """Mean of an amount; wide enough for sums of any group."""
    return ratio(F.sum(column), F.count(column))


def money_mean_over(column: Column, window: WindowSpec) -> Column:
    return ratio(F.sum(column).over(window), F.count(column).over(window))


def item_value(column: Column) -> Column:
    """Amount of one item; narrow enough to be kept in 8 bytes."""
    return F.round(column, 2).cast("decimal(14,2)")


def money(column: Column) -> Column:
    return F.round(column, 2).cast(MONEY)
