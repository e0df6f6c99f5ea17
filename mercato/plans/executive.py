"""Monthly health check."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.dates import month_of
from mercato.functions.exact import MONEY, mean, percent
from mercato.operators.joins import large_join


def month_sentiment(orders: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Mean score, order counts by fate, and the score of the month before."""
    placed = F.col("order_purchase_timestamp")
    bounds = [F.lit(day).cast("timestamp_ntz") for day in (start, end)]
    ordered = orders.where((placed >= bounds[0]) & (placed < bounds[1]))
    if "purchase_month" in orders.columns:  # stored by month: the other months are not read
        ordered = ordered.where(F.col("purchase_month").between(F.lit(start.replace(day=1)), F.lit(end)))
    months = (
        ordered
        .groupBy(month_of(placed).alias("sales_month"))
        .agg(
            mean(F.nullif(F.col("review_score"), F.lit(-1))).alias("avg_review_score"),
            F.count_if(F.col("order_status") == "delivered").alias("delivered_count"),
            F.count_if(F.col("order_status") == "canceled").alias("canceled_count"),
            F.count("order_id").alias("total_order_volume"),
        )
    )
    return months.withColumn(
        "prev_month_sentiment",
        F.lag("avg_review_score").over(Window.orderBy("sales_month")),
    )


def canceled_revenue(fct: DataFrame, orders: DataFrame, measure: str = "item_total_value") -> DataFrame:
    """Value of canceled orders per month of purchase.

    ``measure="price"`` leaves freight out.
    """
    items = fct.select("order_id", "purchase_date", F.col(measure).alias("_value"))
    canceled = orders.where(F.col("order_status") == "canceled").select("order_id")
    # The items of few orders are left before anything is added up, so items are shuffled once.
    return (
        large_join(items, canceled, "order_id")
        .groupBy(month_of(F.col("purchase_date")).alias("sales_month"))
        .agg(F.sum("_value").cast(MONEY).alias("canceled_revenue_loss"))
    )


def executive_summary(
    growth: DataFrame,
    orders: DataFrame,
    fct: DataFrame,
    start: dt.date,
    end: dt.date,
    lost_measure: str = "item_total_value",
    cut: rules.Cutoffs = rules.DEFAULTS,
) -> DataFrame:
    """Revenue, growth, sentiment, fulfilment and leakage of each month."""
    # Both sides of the two joins have one row per month.
    sentiment = month_sentiment(orders, start, end)
    # An item was bought in its order's month, so orders of other months have no item here.
    lost = canceled_revenue(
        whole_months(fct, start, end), stored_months(orders, start, end), lost_measure
    )
    joined = growth.join(F.broadcast(sentiment), "sales_month", "left").join(
        F.broadcast(lost), "sales_month", "left"
    )
    score = F.col("avg_review_score")
    return joined.select(
        "sales_month",
        "sales_month_display",
        "current_month_revenue",
        "mom_growth_pct",
        F.round(score, 2).alias("avg_review_score"),
        percent(F.col("delivered_count"), F.col("total_order_volume")).alias(
            "fulfillment_ratio_pct"
        ),
        F.coalesce("canceled_revenue_loss", F.lit(0).cast(MONEY)).alias("canceled_revenue_loss"),
        rules.health_status(
            F.col("mom_growth_pct"), score, F.col("prev_month_sentiment"), cut
        ).alias("business_health_status"),
        F.col("late_delivery_rate_pct").alias("logistics_pressure_index"),
    )


def _month_bounds(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    after = (end.replace(day=1) + dt.timedelta(days=31)).replace(day=1)
    return start.replace(day=1), after


def stored_months(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of the months that the range touches, if ``df`` is stored by month; else all."""
    if "purchase_month" not in df.columns:
        return df
    first, after = _month_bounds(start, end)
    month = F.col("purchase_month")
    return df.where((month >= F.lit(first)) & (month < F.lit(after)))


def whole_months(fct: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of every month the range touches.

    Lost revenue is a figure of whole months, so the borders of the range do
    not cut it; other months find no partner in the growth table.
    """
    first, after = _month_bounds(start, end)
    day = F.col("purchase_date")
    return stored_months(fct.where((day >= F.lit(first)) & (day < F.lit(after))), start, end)
