"""Dashboard figures over the marts.

Each function returns one row, or one row per label, or the first rows of a
ranking. Means and shares are in the units of the dashboard.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import MONEY, mean, money_mean, percent

LATE_TARGET = Decimal("5")
TOP_SELLERS = "High Dependency Seller (Top 5%)"
CRITICAL = "Critical Risk Lane"


def _mean(column: str) -> Column:
    return F.round(money_mean(F.col(column)), 2).cast(MONEY)


def _share(condition: Column) -> Column:
    """Percentage of rows for which the condition holds."""
    return percent(F.count_if(condition), F.count(F.lit(1)))


def top(df: DataFrame, by: str, key: str, count: int = 1, ascending: bool = False) -> DataFrame:
    """First rows by a measure; equal measures in order of ``key``."""
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(order, key).limit(count)


# Executive page


def total_revenue(growth: DataFrame) -> DataFrame:
    return growth.agg(F.sum("current_month_revenue").cast(MONEY).alias("total_revenue"))


def average_review(summary: DataFrame) -> DataFrame:
    return summary.agg(_mean("avg_review_score").alias("avg_review_score"))


def fulfillment_ratio(summary: DataFrame) -> DataFrame:
    return summary.agg(_mean("fulfillment_ratio_pct").alias("fulfillment_ratio_pct"))


def cancellation_leakage(summary: DataFrame) -> DataFrame:
    return summary.agg(F.sum("canceled_revenue_loss").cast(MONEY).alias("canceled_revenue_loss"))


def months_by_health(summary: DataFrame) -> DataFrame:
    return summary.groupBy("business_health_status").agg(F.count(F.lit(1)).alias("months"))


# Growth page


def average_growth(growth: DataFrame) -> DataFrame:
    return growth.agg(_mean("mom_growth_pct").alias("avg_mom_growth_pct"))


def late_rate(growth: DataFrame, target: Decimal = LATE_TARGET) -> DataFrame:
    """Mean of the monthly rates, the rate over all months, and the target."""
    return growth.agg(
        _mean("late_delivery_rate_pct").alias("mean_monthly_late_pct"),
        percent(F.sum("late_deliveries"), F.sum("total_orders")).alias("overall_late_pct"),
        F.count_if(F.col("late_delivery_rate_pct") > target).alias("months_above_target"),
    )


def largest_day(daily: DataFrame) -> DataFrame:
    return top(daily, "current_day_revenue", "sales_date").select(
        "sales_date", "current_day_revenue"
    )


def volatility_correlation(daily: DataFrame) -> DataFrame:
    pair = [F.col(c).cast("double") for c in ("revenue_average_30d", "revenue_volatility_30d")]
    return daily.agg(F.round(F.corr(*pair), 6).alias("volatility_correlation"))


# Customer page


def repeat_rate(journey: DataFrame) -> DataFrame:
    repeat = F.col("is_repeat_buyer") == 1
    return journey.agg(
        _share(repeat).alias("repeat_customer_pct"), _share(~repeat).alias("one_time_pct")
    )


def repeat_revenue_share(journey: DataFrame) -> DataFrame:
    worth = F.col("total_lifetime_revenue")
    return journey.agg(
        percent(F.sum(F.when(F.col("is_repeat_buyer") == 1, worth)), F.sum(worth)).alias(
            "repeat_revenue_pct"
        )
    )


def repeat_lifespan(journey: DataFrame) -> DataFrame:
    return journey.where(F.col("is_repeat_buyer") == 1).agg(
        _mean("customer_lifespan_days").alias("avg_lifespan_days")
    )


def return_rate(journey: DataFrame) -> DataFrame:
    return journey.agg(_share(F.col("is_returned_90d") == 1).alias("return_rate_pct"))


def return_rate_by_score(journey: DataFrame) -> DataFrame:
    return journey.groupBy("first_order_review_score").agg(
        F.count(F.lit(1)).alias("customers"),
        _share(F.col("is_returned_90d") == 1).alias("return_rate_pct"),
    )


# Product page


def top_revenue_category(matrix: DataFrame) -> DataFrame:
    return top(matrix, "total_revenue", "product_category").select(
        "product_category", "total_revenue"
    )


def best_loved_category(matrix: DataFrame) -> DataFrame:
    return top(matrix, "avg_review_score", "product_category").select(
        "product_category", "avg_review_score"
    )


def most_toxic_category(matrix: DataFrame) -> DataFrame:
    return top(matrix, "toxicity_ratio_pct", "product_category").select(
        "product_category", "toxicity_ratio_pct"
    )


def quadrant_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("matrix_position").agg(
        F.count(F.lit(1)).alias("categories"),
        F.sum("total_revenue").cast(MONEY).alias("total_revenue"),
    )


# Logistics page


def freight_share(economics: DataFrame) -> DataFrame:
    return economics.agg(
        F.round(mean(F.col("freight_ratio")) * 100, 2).alias("avg_freight_ratio_pct")
    )


def mean_efficiency(economics: DataFrame) -> DataFrame:
    return economics.agg(_mean("regional_efficiency_index").alias("avg_efficiency_index"))


def mean_transaction(economics: DataFrame) -> DataFrame:
    return economics.agg(_mean("total_order_payment_value").alias("avg_transaction_value"))


def basket_by_installments(economics: DataFrame) -> DataFrame:
    return economics.groupBy("installment_group").agg(
        F.count(F.lit(1)).alias("items"),
        _mean("total_order_payment_value").alias("avg_transaction_value"),
    )


def score_by_freight(economics: DataFrame) -> DataFrame:
    return economics.groupBy("freight_ratio_bucket").agg(
        F.count(F.lit(1)).alias("items"), _mean("review_score").alias("avg_review_score")
    )


def freight_by_state(economics: DataFrame, count: int = 3) -> DataFrame:
    costs = economics.groupBy("seller_state").agg(
        _mean("freight_value").alias("avg_freight"),
        F.sum("freight_value").cast(MONEY).alias("total_freight"),
    )
    return top(costs, "avg_freight", "seller_state", count)


# Risk page


def critical_lanes(risk_map: DataFrame) -> DataFrame:
    return risk_map.agg(
        F.count_if(F.col("strategic_risk_status") == CRITICAL).alias("critical_lanes")
    )


def top_seller_share(risk_map: DataFrame) -> DataFrame:
    revenue = F.col("seller_category_revenue")
    in_top = F.col("dependency_segment") == TOP_SELLERS
    return risk_map.agg(
        percent(F.sum(F.when(in_top, revenue)), F.sum(revenue)).alias("top_seller_revenue_pct")
    )


def top_sellers_by_state(risk_map: DataFrame) -> DataFrame:
    """Share of each state among the sellers that hold a top lane."""
    sellers = (
        risk_map.where(F.col("dependency_segment") == TOP_SELLERS)
        .select("seller_id", "seller_state")
        .distinct()
    )
    by_state = sellers.groupBy("seller_state").agg(F.count(F.lit(1)).alias("sellers"))
    # A seller has one state, so the states add up to all sellers; one row
    # per state from here on.
    everyone = by_state.agg(F.sum("sellers")).scalar()
    return by_state.withColumn("seller_pct", percent(F.col("sellers"), everyone))


def late_rate_by_lane(risk_map: DataFrame, count: int = 10) -> DataFrame:
    rates = risk_map.groupBy("transit_lane").agg(
        _mean("lane_late_rate_pct").alias("avg_late_rate_pct")
    )
    return top(rates, "avg_late_rate_pct", "transit_lane", count)


def late_rate_by_shipping(risk_map: DataFrame) -> DataFrame:
    return risk_map.groupBy("shipping_type").agg(
        _mean("lane_late_rate_pct").alias("avg_late_rate_pct")
    )


def platform_late_rate(risk_map: DataFrame) -> DataFrame:
    """Mean over lane rows, and the rate over all items."""
    return risk_map.agg(
        _mean("lane_late_rate_pct").alias("mean_lane_late_pct"),
        percent(F.sum("total_late_orders"), F.sum("total_category_orders")).alias(
            "overall_late_pct"
        ),
    )
