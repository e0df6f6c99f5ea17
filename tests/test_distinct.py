"""Distinct counts that merge, and the marts made from daily sales."""

import datetime as dt
import re

import pytest
from market import BASE, item, order, raw
from pyspark.sql import functions as F

from mercato.operators.distinct import distinct_state, merge_state
from mercato.operators.durable import new_path
from mercato.plans import growth, staging
from mercato.plans.warehouse import Warehouse

RANGE = {"start": dt.date(2018, 1, 1), "end": dt.date(2018, 7, 1)}
TIME_MARTS = ("monthly_growth", "monthly_growth_diff", "daily_volatility", "executive_summary")


def staged(spark, tables):
    folder = new_path(spark, "distinct-tests")
    with Warehouse.from_raw(tables, **RANGE) as warehouse:
        warehouse.stage(folder)
    return Warehouse.from_staged(spark, folder, **RANGE)


def test_states_merge_to_exact_counts(spark):
    """Numbers in several groups, on both sides of block borders, one of which holds half the rows."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, 32_768).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) + 1).alias("number"),
        (F.col("id") % 7).alias("day"),
        F.lit(1).alias("n"),
    )
    rows = rows.unionByName(spark.range(5).selectExpr("CAST(NULL AS BIGINT) AS number", "CAST(3 AS BIGINT) AS day", "1 AS n"))
    state = distinct_state(rows, "day", "number", ["n"])
    wanted = {r["day"]: (r["n"], r["c"]) for r in rows.groupBy("day").agg(F.sum("n").alias("n"), F.countDistinct("number").alias("c")).collect()}
    assert {r["day"]: (r["n"], r["c"]) for r in merge_state(state, "day", ["n"], "c").collect()} == wanted
    both = merge_state(state.withColumn("half", F.col("day") < 4), "half", ["n"], "c").collect()
    whole = rows.withColumn("half", F.col("day") < 4).groupBy("half").agg(F.sum("n").alias("n"), F.countDistinct("number").alias("c"))
    assert {tuple(r) for r in both} == {(r["half"], r["n"], r["c"]) for r in whole.collect()}
    nothing = distinct_state(rows.limit(0), "day", "number", ["n"])
    assert merge_state(nothing, "day", ["n"], "c").collect() == []


def test_bitmaps_are_made_of_whole_blocks(spark):
    rows = spark.range(10).selectExpr("id % 7 AS number", "id % 3 AS day", "1 AS n")
    plan = distinct_state(rows, "day", "number", ["n"])._jdf.queryExecution().executedPlan().toString()
    # Two shuffles: of rows that are added up before, and of blocks, behind which no bitmap moves.
    assert plan.count("Exchange") == 2
    above = plan[: plan.index("Exchange")]
    assert len(re.findall("bitmap_construct_agg", above)) >= 2 and "bitmap_construct_agg" not in plan[plan.index("Exchange") :]


def test_orders_are_numbered_once(spark):
    orders = raw(spark, orders=[*BASE["orders"], order("o1", "c3", "2018-03-09 00:00:00"), order(None, "c1", "2018-01-01 00:00:00"), order("o9", "c1", None)])["orders"]
    rows = staging.order_numbers(orders).orderBy("order_number").collect()
    assert [(r["order_number"], r["order_id"]) for r in rows] == [
        (1, "o1"), (2, "o2"), (3, "o3"), (4, "o4"), (5, "o5"), (6, "o6"), (7, "o7"), (8, "o9")
    ]


@pytest.mark.parametrize("case", ["plain", "repeated order", "hot order", "empty"])
def test_marts_of_daily_sales_equal_those_of_the_fact(spark, case):
    changes = {}
    if case == "repeated order":
        # One order on three days of two months: it counts once for each day and month.
        again = [order("o1", "c3", "2018-01-12 00:00:00"), order("o1", "c4", "2018-02-01 09:00:00"), order("o3", "c3", "2018-02-01 23:00:00")]
        changes = {"orders": BASE["orders"] + again}
    elif case == "hot order":
        changes = {"items": BASE["items"] + [item("o4", 2 + i) for i in range(3000)]}
    elif case == "empty":
        changes = {"items": []}
    tables = raw(spark, **changes)
    stored = staged(spark, tables)
    with Warehouse.from_raw(tables, **RANGE) as direct:
        # A fact without rows has no file to read a schema from.
        for name in TIME_MARTS[: 3 if case == "empty" else 4]:
            left, right = getattr(stored, name), getattr(direct, name)
            assert left.columns == right.columns
            assert left.dtypes == right.dtypes, name
            assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect())), name
    if case == "repeated order":
        days = stored.daily_sales.where("purchase_date IS NOT NULL").withColumn("all", F.lit(1))
        assert growth.revenue_totals(days, "all", "whole").first()["total_orders"] == 6


def test_staged_marts_read_no_detail_rows(spark):
    stored = staged(spark, raw(spark))
    for name in TIME_MARTS[:3]:
        assert {file.split("/")[-2] for file in getattr(stored, name).inputFiles()} == {"daily_sales"}
