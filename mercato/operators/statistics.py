"""Single figures and small per-key figures used next to detail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def figure(df: DataFrame, aggregate: Column) -> Column:
    """One aggregate over all of ``df`` as a column (a scalar subquery)."""
    return df.agg(aggregate).scalar()


def with_label_sums(
    df: DataFrame, label: str, partial_sums: DataFrame, total: str, count: str
) -> DataFrame:
    """Add a total and a count over all rows with the same ``label``.

    ``partial_sums`` holds both under their names, next to ``label``, for any
    finer grouping. ``label`` takes a handful of fixed values (or NULL, which
    forms a group of its own), hence the broadcast.
    """
    sums = partial_sums.groupBy(F.col(label).alias("_label")).agg(
        F.sum(total).alias(total), F.sum(count).alias(count)
    )
    return df.join(
        F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label")), "left"
    ).drop("_label")
