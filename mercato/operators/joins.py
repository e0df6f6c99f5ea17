"""Joins of tables that both grow with the data, and of a few names with their numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def large_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Sort-merge join on ``on``, whatever the planner estimates.

    Size estimates come from compressed files before any filter or aggregate,
    so a side that looks small on disk could be broadcast although it is not.
    Sorting spills, and AQE splits a key that holds many rows. Lookups of
    small tables are left to the planner's size check instead.
    """
    return left.join(right.hint("merge"), on, how)


def numbered_names(df: DataFrame, names: list[str], number: str) -> DataFrame:
    """The different combinations of ``names``, NULLs included, with ``number`` = 1..n.

    For a few combinations: one task numbers them, and every task of a join with them gets all.
    """
    return (
        df.select(*names)
        .distinct()
        .withColumn(number, F.row_number().over(Window.orderBy(*names)))
    )


def name_numbers(df: DataFrame, known: DataFrame, names: list[str], number: str) -> DataFrame:
    """``df`` with the ``number`` of its ``names``; ``known`` are its ``numbered_names``.

    A number takes a fraction of the bytes of the names where rows are shuffled.
    """

    def same(name: str) -> Column:
        return F.col(name).eqNullSafe(F.col(f"_known_{name}"))

    others = known.select(*(F.col(name).alias(f"_known_{name}") for name in names), number)
    joined = df.join(F.broadcast(others), reduce(Column.__and__, map(same, names)))
    return joined.drop(*(f"_known_{name}" for name in names))


def names_of_numbers(df: DataFrame, known: DataFrame, number: str) -> DataFrame:
    """``df`` with the names that belong to its ``number``."""
    return df.join(F.broadcast(known), number)
