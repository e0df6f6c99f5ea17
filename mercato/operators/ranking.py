"""Global and per-group positions without a one-task sort.

Rows are split into ordered slices, and a position is the size of the slices
before plus the position within the slice. Only slice sizes meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators.durable import written

# monotonically_increasing_id keeps the partition above the row's position.
POSITION_BITS = 33


# Writes a frame under a label, once, and reads it back.
Writer = Callable[[DataFrame, str], DataFrame]


def ordered_index(
    df: DataFrame, keys: list[str], name: str, write: Writer = written
) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``keys``, n being the row count.

    The slices are range partitions. They are written once, so that every
    later step sees the same borders, and only their sizes are added up.
    Rows equal in all keys are spread over slices by their place in the
    source, so a large group of copies does not end up in one task. ``df``
    should be a scan or a written table, whose row order is the same when a
    lost task is run again.
    """
    order = [F.col(key).asc_nulls_last() for key in keys] + [F.col("_place")]
    sliced = (
        df.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_place")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    rows = (
        write(sliced, "ordered-index")
        .withColumn("_slice", F.shiftrightunsigned("_at", POSITION_BITS))
        .withColumn("_position", F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
    )
    sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    # One row per slice: the number of range partitions bounds this broadcast.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        rows.join(F.broadcast(starts), "_slice")
        .withColumn(name, F.col("_start") + F.col("_position") + 1)
        .drop("_slice", "_at", "_position", "_start")
    )


# Steps per unit of the natural logarithm: a step spans a tenth of a percent.
STEPS = 1024


def magnitude(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows.

    Amounts up to 10**15 fall into fewer than 36,000 steps on either side of
    zero, and a step holds at most ``value / 10`` different amounts in cents.
    """
    number = value.cast("double")
    return F.floor(F.signum(number) * F.log1p(F.abs(number)) * STEPS)


def percent_rank_desc(
    df: DataFrame, group: str, value: str, name: str, write: Writer | None = None
) -> DataFrame:
    """Add the percent rank of a number in descending order within ``group``.

    Equal values are counted before anything is sorted, and the distinct
    values of a group are sorted one magnitude at a time, so neither a group
    nor a value that holds most rows is gathered in one task. The rows are
    counted and then joined with their ranks; with ``write`` they are written
    first, so that ``df`` is computed once only.
    """
    rows = write(df, "ranked-rows") if write else df
    # A group or a value may be NULL, their struct is not: one shuffle by it serves join and window.
    step = F.struct(F.col(group).alias("group"), magnitude(F.col(value)).alias("step"))
    counted = (
        rows.groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(step.alias("_step"), F.col(value).alias("_rank_value"), "_n")
    )
    in_group = Window.partitionBy("_total_step.group")
    higher_steps = in_group.orderBy(F.col("_total_step.step").desc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        counted.groupBy(F.col("_step").alias("_total_step"))
        .agg(F.sum("_n").alias("_step_n"))
        .select(
            "_total_step",
            F.coalesce(F.sum("_step_n").over(higher_steps), F.lit(0)).alias("_before"),
            F.sum("_step_n").over(in_group).alias("_group_n"),
        )
    )
    higher_values = (
        Window.partitionBy("_step")
        # The double settles nearly every comparison, the exact value the rest.
        .orderBy(
            F.col("_rank_value").cast("double").desc_nulls_first(),
            F.col("_rank_value").desc_nulls_first(),
        )
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    above = F.col("_before") + F.coalesce(F.sum("_n").over(higher_values), F.lit(0))
    share = above.cast("double") / (F.col("_group_n") - 1)
    ranks = counted.join(totals, F.col("_step") == F.col("_total_step")).select(
        F.col("_step.group").alias("_rank_group"),
        "_rank_value",
        F.when(F.col("_group_n") > 1, share).otherwise(F.lit(0.0)).alias(name),
    )
    # The ranks are distinct values, which hash evenly over the partitions.
    return rows.join(
        ranks.hint("shuffle_hash"),
        F.col(group).eqNullSafe(F.col("_rank_group"))
        & F.col(value).eqNullSafe(F.col("_rank_value")),
    ).drop("_rank_group", "_rank_value")


def first_rows(
    df: DataFrame, group: str, order: list[Column], count: int, name: str
) -> DataFrame:
    """The first ``count`` rows of each group, numbered in ``name``.

    The filter on the row number lets Spark cut each group down to ``count``
    rows before the shuffle, so a large group stays spread out.
    """
    numbered = df.withColumn(
        name, F.row_number().over(Window.partitionBy(group).orderBy(*order))
    )
    return numbered.where(F.col(name) <= count)
