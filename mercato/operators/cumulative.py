"""Running totals of a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators.ranking import magnitude
from mercato.operators.statistics import figure

#: Steps of magnitude in a block: amounts up to 10**15 make fewer than 150 blocks.
BLOCK_STEPS = 512


def running_total_desc(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of all values that are not below the row's own, a decimal's, in ``name``.

    That is a window's sum in descending order with a RANGE frame: equal values
    have the same total, and so do NULLs, which come first and have none. Equal values
    are added up before anything is ordered. Of the sums of blocks there is a
    bounded list, in which each row looks up what lies above its block;
    within a block the steps are ordered, and within a step the distinct values. A
    step spans a tenth of a percent, so no step, value or block is a task that
    grows like the table. ``rows`` is read several times and should be a written table.
    """
    kind = rows.schema[value].dataType
    amount = F.col(value)
    step = magnitude(amount)
    summed = (
        rows.where(amount.isNotNull())
        .groupBy(value)
        .agg(F.sum(value).alias("_sum"))
        .withColumns({"_step": step, "_block": F.floor(step / BLOCK_STEPS)})
    )
    steps = summed.groupBy("_block", "_step").agg(F.sum("_sum").alias("_step_sum"))
    blocks = steps.groupBy("_block").agg(F.sum("_step_sum").alias("_block_sum"))
    listed = figure(blocks, F.collect_list(F.struct("_block", "_block_sum")))
    wide = "decimal(38,%d)" % kind.scale
    nothing = F.lit(0).cast(wide)
    above_blocks = F.aggregate(
        F.col("_blocks"),
        nothing,
        lambda total, other: F.when(
            other["_block"] > F.col("_block"), (total + other["_block_sum"]).cast(wide)
        ).otherwise(total),
    )
    earlier = (Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("_block").orderBy(F.col("_step").desc()).rowsBetween(*earlier)
    before_step = (
        steps.withColumn("_blocks", listed)
        .withColumn(
            "_above",
            (above_blocks + F.coalesce(F.sum("_step_sum").over(in_block), nothing)).cast(wide),
        )
        .select(F.col("_step").alias("_their_step"), "_above")
    )
    in_step = Window.partitionBy("_step").orderBy(amount.desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = (
        summed.withColumn("_within", F.sum("_sum").over(in_step))
        .join(before_step, F.col("_step") == F.col("_their_step"))
        .select(amount.alias("_value"), (F.col("_above") + F.col("_within")).cast(wide).alias(name))
    )
    # One row for each distinct value, which hash evenly.
    return rows.join(totals.hint("shuffle_hash"), amount == F.col("_value"), "left").drop("_value")
