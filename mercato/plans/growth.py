"""Revenue over time: months and days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions import rules
from mercato.functions.dates import date_between, month_label, month_of
from mercato.functions.exact import MONEY, money, money_mean_over, percent, ratio
from mercato.operators.distinct import BITS, BLOCK, distinct_state, is_state, merge_state


# The windows in this module have no partition key: they run over one row per
# month or per day of the analysis range, whatever the size of the fact.


def _by_month() -> WindowSpec:
    return Window.orderBy("sales_month")


def in_range(fct: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows bought in ``[start, end)``; a staged fact is also pruned by month."""
    kept = fct.where(date_between(F.col("purchase_date"), start, end))
    if "purchase_month" in fct.columns:
        kept = kept.where(
            F.col("purchase_month").between(F.lit(start.replace(day=1)), F.lit(end))
        )
    return kept


#: What is added up by day and by month.
MEASURES = ["price", "freight_value", "item_total_value", "is_late"]
DAILY_SALES = T.StructType(
    [T.StructField("purchase_date", T.DateType()), T.StructField(BLOCK, T.LongType())]
    + [T.StructField(name, T.LongType() if name == "is_late" else T.DecimalType(38, 2)) for name in MEASURES]
    + [T.StructField(BITS, T.BinaryType())]
)


def daily_sales(fct: DataFrame) -> DataFrame:
    """Sums and bitmaps of the order numbers by day of purchase, from which any longer period is made.

    ``fct`` has ``order_number`` (``staging.order_numbers``). The functions of this
    module take this table in the place of the fact.
    """
    state = distinct_state(fct, "purchase_date", "order_number", MEASURES)
    return state.select(*(F.col(field.name).cast(field.dataType) for field in DAILY_SALES))


def revenue_totals(fct: DataFrame, period: str, stem: str) -> DataFrame:
    if is_state(fct):
        return merge_state(fct, period, MEASURES, "total_orders").select(
            period,
            F.col("price").cast(MONEY).alias(f"{stem}_sale"),
            F.col("freight_value").cast(MONEY).alias(f"{stem}_freight"),
            F.col("item_total_value").cast(MONEY).alias(f"{stem}_revenue"),
            "total_orders",
            F.col("is_late").alias("late_deliveries"),
        )
    return fct.groupBy(period).agg(
        F.sum("price").cast(MONEY).alias(f"{stem}_sale"),
        F.sum("freight_value").cast(MONEY).alias(f"{stem}_freight"),
        F.sum("item_total_value").cast(MONEY).alias(f"{stem}_revenue"),
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("is_late").alias("late_deliveries"),
    )


def month_totals(fct: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    bought = in_range(fct, start, end).withColumn(
        "sales_month", month_of(F.col("purchase_date"))
    )
    return revenue_totals(bought, "sales_month", "current_month")


def _with_previous(months: DataFrame) -> DataFrame:
    revenue, previous = F.col("current_month_revenue"), F.col("prev_month_revenue")
    return months.withColumn(
        "prev_month_revenue", F.lag(revenue).over(_by_month())
    ).withColumns(
        {
            "sales_month_display": month_label(F.col("sales_month")),
            "mom_revenue_diff": (revenue - previous).cast(MONEY),
            "mom_growth_pct": percent(revenue - previous, previous),
            "late_delivery_rate_pct": percent(F.col("late_deliveries"), F.col("total_orders")),
        }
    )


def monthly_growth(
    fct: DataFrame,
    start: dt.date,
    end: dt.date,
    baseline: str = "rolling",
    cut: rules.Cutoffs = rules.DEFAULTS,
) -> DataFrame:
    """Month totals, growth on the month before, and a seasonality index.

    The index compares with the mean of the three preceding months on file
    (``baseline="rolling"``) or of all months (``"global"``).
    """
    return seasonality(_with_previous(month_totals(fct, start, end)), baseline, cut).select(
        "sales_month",
        "sales_month_display",
        "current_month_sale",
        "current_month_freight",
        "current_month_revenue",
        "prev_month_revenue",
        "mom_growth_pct",
        "seasonality_index",
        "total_orders",
        "late_deliveries",
        "late_delivery_rate_pct",
        "growth_classification",
        "cycle_event",
    )


def seasonality(
    months: DataFrame, baseline: str = "rolling", cut: rules.Cutoffs = rules.DEFAULTS
) -> DataFrame:
    """Add index, class and calendar event to rows of month and revenue."""
    frames = {"rolling": _by_month().rowsBetween(-3, -1), "global": Window.partitionBy()}
    if baseline not in frames:
        raise ValueError(f"unknown baseline: {baseline}")
    revenue, frame = F.col("current_month_revenue"), frames[baseline]
    # Revenue over the mean of the frame, without rounding the mean first.
    scaled, total = revenue * F.col("_months"), F.col("_revenue")
    return (
        months.withColumns(
            {"_months": F.count(revenue).over(frame), "_revenue": F.sum(revenue).over(frame)}
        )
        .withColumns(
            {
                "seasonality_index": percent(scaled, total),
                "growth_classification": rules.growth_class(ratio(scaled, total), total, cut),
                "cycle_event": rules.calendar_event(F.col("sales_month")),
            }
        )
        .drop("_months", "_revenue")
    )


def monthly_growth_diff(fct: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Month totals with the absolute change, without a baseline."""
    return _with_previous(month_totals(fct, start, end)).select(
        "sales_month",
        "sales_month_display",
        "current_month_sale",
        "current_month_freight",
        "current_month_revenue",
        "prev_month_revenue",
        "mom_revenue_diff",
        "mom_growth_pct",
        "total_orders",
        "late_deliveries",
        "late_delivery_rate_pct",
    )


def daily_volatility(
    fct: DataFrame, start: dt.date, end: dt.date, days: int = 30
) -> DataFrame:
    """Day totals with mean and deviation over the last ``days`` selling days."""
    bought = in_range(fct, start, end).withColumnRenamed("purchase_date", "sales_date")
    totals = revenue_totals(bought, "sales_date", "current_day").drop("late_deliveries")
    trailing = Window.orderBy("sales_date").rowsBetween(1 - days, 0)
    revenue = F.col("current_day_revenue")
    deviation = F.coalesce(F.stddev_samp(revenue).over(trailing), F.lit(0.0))
    return totals.select(
        "sales_date",
        "current_day_sale",
        "current_day_freight",
        "current_day_revenue",
        "total_orders",
        money(money_mean_over(revenue, trailing)).alias(f"revenue_average_{days}d"),
        money(deviation.cast("decimal(38,10)")).alias(f"revenue_volatility_{days}d"),
    )
