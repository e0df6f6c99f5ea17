"""Exact distinct counts that add up.

A state holds one row for each group and block of 32,768 numbers: sums, and the numbers seen
as the bits of a bitmap. States of finer groups merge into those of coarser ones without
the rows they came from, and a value seen in several groups counts once. With numbers that
are dense, and close together within a group, a state is far smaller than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BITS = "number_block", "number_bits"


def is_state(df: DataFrame) -> bool:
    return BITS in df.columns


def _sums(columns: list[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in columns]


def distinct_state(df: DataFrame, by: str, number: str, sums: list[str]) -> DataFrame:
    """The state of ``df`` by one column: sums of ``sums``, and which ``number`` there are.

    Rows of the same number are added up before they are shuffled, so a number that
    holds most rows is no large group. A task gets whole blocks before it makes bitmaps, as
    a bitmap takes 4 KB however few bits it has. A null number adds to the
    sums and to no count.
    """
    block = F.bitmap_bucket_number(F.col(number))
    single = df.withColumn(BLOCK, block).groupBy(by, BLOCK, number).agg(*_sums(sums))
    return (
        single.repartition(by, BLOCK)
        .groupBy(by, BLOCK)
        .agg(*_sums(sums), F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias(BITS))
    )


def merge_state(state: DataFrame, by: str, sums: list[str], count: str) -> DataFrame:
    """Sums by a coarser (or the same) column, and the distinct numbers as ``count``."""
    blocks = state.groupBy(by, BLOCK).agg(*_sums(sums), F.bitmap_or_agg(BITS).alias(BITS))
    return blocks.groupBy(by).agg(*_sums(sums), F.sum(F.bitmap_count(BITS)).alias(count))
