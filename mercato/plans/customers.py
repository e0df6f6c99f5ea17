"""Customer journey and win-back targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.exact import MONEY, money_mean
from mercato.operators.joins import large_join
from mercato.operators.ranking import first_rows
from mercato.operators.statistics import figure


def customer_stats(fct: DataFrame) -> DataFrame:
    return fct.groupBy("customer_unique_id").agg(
        F.countDistinct("order_id").alias("total_lifetime_orders"),
        F.sum("item_total_value").cast(MONEY).alias("total_lifetime_revenue"),
    )


def first_touches(fct: DataFrame) -> DataFrame:
    """Order of the first item row and date of the second, per customer.

    The sequence runs over item rows: the second row may belong to the first
    order. Order and item number settle equal dates.
    """
    order = [
        F.col(name).asc_nulls_last()
        for name in ("purchase_date", "order_id", "item_sequence_number")
    ]
    bought = fct.where(F.col("customer_unique_id").isNotNull()).select(
        "customer_unique_id", "order_id", "item_sequence_number", "purchase_date"
    )
    touches = first_rows(bought, "customer_unique_id", order, 2, "order_seq")

    def at(position: int, name: str):
        return F.max(F.when(F.col("order_seq") == position, F.col(name)))

    return touches.groupBy("customer_unique_id").agg(
        at(1, "order_id").alias("first_order_id"),
        at(2, "purchase_date").alias("second_order_date"),
    )


def customer_states(fct: DataFrame) -> DataFrame:
    """Orders, revenue, the order of the first item row and the date of the second, per customer.

    The sequence runs over item rows by date, order and item number, NULLs last: the
    second row may belong to the first order. Item rows become one row per
    customer, order and date, which is the only shuffle of the fact and combines an order's
    rows before it. Of those a customer needs the first, the last one of its day,
    and the days: with two rows on the first day the second row is of that
    day, else of the next. A customer's state thus is bounded by the days of the
    calendar, is merged task by task, and no list of rows is ever formed.
    """
    days = (
        fct.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id", "order_id", "purchase_date")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("item_total_value").cast(MONEY).alias("revenue"),
        )
    )
    day, order = F.col("purchase_date"), F.col("order_id")
    undated, unnamed = day.isNull().alias("undated"), order.isNull().alias("unnamed")
    first = F.struct(undated, day, unnamed, order, "rows")
    last_of_first_day = F.struct((~day.isNull()).alias("dated"), -F.unix_date(day), unnamed, order)
    states = days.groupBy("customer_unique_id").agg(
        F.countDistinct("order_id").alias("total_lifetime_orders"),
        F.sum("revenue").cast(MONEY).alias("total_lifetime_revenue"),
        F.min(first).alias("first"),
        F.max(last_of_first_day).alias("last"),
        F.sort_array(F.collect_set(day)).alias("days"),
    )
    same_day = (F.col("first.rows") > 1) | ~F.col("first.order_id").eqNullSafe(F.col("last.order_id"))
    return states.select(
        "customer_unique_id",
        "total_lifetime_orders",
        "total_lifetime_revenue",
        F.col("first.order_id").alias("first_order_id"),
        F.when(same_day, F.col("first.purchase_date"))
        .otherwise(F.get("days", F.lit(1)))
        .alias("second_order_date"),
    )


def customer_journey(
    fct: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    cut: rules.Cutoffs = rules.DEFAULTS,
) -> DataFrame:
    """One row per customer with at least one item."""
    scores = orders.select(
        F.col("order_id").alias("first_order_id"),
        F.col("review_score").alias("first_order_review_score"),
    )
    states = large_join(customer_states(fct), scores, "first_order_id", "left")
    last_day = figure(fct, F.max("purchase_date"))
    first_day = F.col("first_order").cast("date")
    recent_day = F.col("recent_order").cast("date")
    known = large_join(customers, states, "customer_unique_id")
    return known.withColumn("recency_days", F.datediff(last_day, recent_day)).select(
        "customer_unique_id",
        "customer_city",
        "customer_state",
        first_day.alias("first_order_date"),
        "first_order_review_score",
        "second_order_date",
        rules.returned_within(first_day, F.col("second_order_date"), cut).alias(
            "is_returned_90d"
        ),
        recent_day.alias("recent_order_date"),
        "total_lifetime_orders",
        "total_lifetime_revenue",
        (F.col("customer_lifespan_days") + 1).alias("customer_lifespan_days"),
        "is_repeat_buyer",
        "recency_days",
        rules.churned(F.col("recency_days"), cut).alias("is_churned"),
    )


def winback_segmentation(
    journey: DataFrame, cut: rules.Cutoffs = rules.DEFAULTS
) -> DataFrame:
    """Churned, once satisfied customers worth more than the mean customer."""
    worth = F.col("total_lifetime_revenue")
    return (
        journey.where(
            (F.col("is_churned") == 1)
            & (F.col("first_order_review_score") >= cut.winback_score)
            & (worth > figure(journey, money_mean(worth)))
        )
        .select(
            "customer_unique_id",
            "customer_city",
            "customer_state",
            "first_order_date",
            "recent_order_date",
            "recency_days",
            "first_order_review_score",
            worth.alias("potential_recovery_value"),
            "total_lifetime_orders",
            rules.recovery_priority(F.col("is_repeat_buyer")).alias("recovery_priority"),
        )
        .orderBy(F.col("potential_recovery_value").desc_nulls_first(), "customer_unique_id")
    )
