"""Business rules as column functions over parameterised cut-offs.

The labels and the default cut-offs are fixed values: reports depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal as D

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.dates import fractional_days
from mercato.functions.exact import percent, ratio


@dataclass(frozen=True)
class Cutoffs:
    """Every threshold of the marts. The defaults are fixed values."""

    small_below_cm3: int = 5_000
    medium_up_to_cm3: int = 20_000
    large_up_to_cm3: int = 50_000
    peak_above: D = D("1.20")
    slow_below: D = D("0.80")
    toxic_score_factor: D = D("0.98")
    return_days: int = 90
    churn_days: int = 180
    winback_score: D = D("4")
    pareto_share: D = D("0.80")
    loved_score: D = D("4.0")
    disliked_score: D = D("3.5")
    emerging_above: D = D("0.20")
    declining_below: D = D("-0.10")
    band_days: int = 90
    outlier_above: D = D("1.5")
    expensive_above: D = D("1.1")
    efficient_below: D = D("0.9")
    low_freight_up_to: D = D("0.10")
    mid_freight_up_to: D = D("0.20")
    high_freight_up_to: D = D("0.50")
    single_pay_up_to: int = 1
    short_term_up_to: int = 5
    mid_term_up_to: int = 10
    top_seller_rank: float = 0.05
    critical_late_above: D = D("0.20")
    critical_score_below: D = D("3.5")
    bottleneck_late_above: D = D("0.15")


DEFAULTS = Cutoffs()


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """First label whose condition holds; a NULL condition does not."""
    chain = F
    for condition, label in steps:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


# Customers


def repeat_buyer(first_order: Column, recent_order: Column) -> Column:
    return flag(recent_order > first_order)


def returned_within(first: Column, second: Column, cut: Cutoffs = DEFAULTS) -> Column:
    gap = F.datediff(second, first)
    return flag((gap > 0) & (gap <= cut.return_days))


def churned(recency_days: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return flag(recency_days > cut.churn_days)


def recovery_priority(is_repeat: Column) -> Column:
    return ladder(
        (is_repeat == 1, "High Priority: Lapsed Loyal"),
        otherwise="Medium Priority: Lapsed One-Time",
    )


# Products


def category_name(english: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(english, F.lit("")), original)


def filled_category(category: Column) -> Column:
    return F.coalesce(F.nullif(category, F.lit("")), F.lit("Uncategorized"))


def size_bucket(volume: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return ladder(
        (volume.isNull(), "Unknown"),
        (volume < cut.small_below_cm3, "Small"),
        (volume <= cut.medium_up_to_cm3, "Medium"),
        (volume <= cut.large_up_to_cm3, "Large"),
        otherwise="Extra Large",
    )


def pareto_segment(cumulative: Column, total: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return ladder(
        (ratio(cumulative, total) <= cut.pareto_share, "Pareto Driver (Top 80%)"),
        otherwise="Long Tail",
    )


def toxicity_percent(one_star: Column, reviews: Column, minimum_reviews: int = 0) -> Column:
    """Share of one-star reviews; NULL below ``minimum_reviews`` reviews."""
    share = percent(one_star, reviews)
    return F.when(reviews >= minimum_reviews, share) if minimum_reviews else share


def quadrant(
    revenue: Column, mean_revenue: Column, score: Column, cut: Cutoffs = DEFAULTS
) -> Column:
    big = revenue > mean_revenue
    loved = score >= cut.loved_score
    return ladder(
        (big & loved, "Core Strengths"),
        (big & (score < cut.disliked_score), "Revenue Traps"),
        ((revenue <= mean_revenue) & loved, "Niche Winners"),
        otherwise="Underperformers",
    )


def lifecycle(recent: Column, previous: Column, cut: Cutoffs = DEFAULTS) -> Column:
    change = ratio(recent - previous, previous)
    return ladder(
        (previous == 0, "New"),
        (change > cut.emerging_above, "Emerging"),
        (change < cut.declining_below, "Declining"),
        otherwise="Stable",
    )


def recent_band(day: Column, last_day: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return day >= F.date_sub(last_day, cut.band_days)


def previous_band(day: Column, last_day: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return (day < F.date_sub(last_day, cut.band_days)) & (
        day >= F.date_sub(last_day, 2 * cut.band_days)
    )


# Orders and delivery


def days_to_delivery(purchased: Column, delivered: Column) -> Column:
    return fractional_days(purchased, delivered)


def late(delivered: Column, estimated: Column) -> Column:
    return flag(delivered > estimated)


def delivered(status: Column) -> Column:
    return flag(status == "delivered")


# Growth


def growth_class(against: Column, baseline: Column, cut: Cutoffs = DEFAULTS) -> Column:
    """``against`` is revenue over the baseline."""
    return ladder(
        (against > cut.peak_above, "Seasonal Peak"),
        (against < cut.slow_below, "Slow Period"),
        (baseline.isNull(), "Initializing"),
        otherwise="Organic/Stable",
    )


def calendar_event(day: Column) -> Column:
    month = F.month(day)
    return ladder(
        (month == 11, "Black Friday"),
        (month == 12, "Holiday Season"),
        (month == 3, "Consumer Day"),
        otherwise="Regular",
    )


def health_status(
    growth: Column, score: Column, previous_score: Column, cut: Cutoffs = DEFAULTS
) -> Column:
    return ladder(
        ((growth > 0) & (score < previous_score * F.lit(cut.toxic_score_factor)), "Toxic Growth"),
        ((growth > 0) & (score >= previous_score), "Efficient Scaling"),
        (growth < 0, "Contraction"),
        otherwise="Stable",
    )


# Freight and payments


def efficiency_status(index: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return ladder(
        (index > cut.outlier_above, "Critical Outlier (>1.5x Avg)"),
        (index > cut.expensive_above, "Expensive Transaction"),
        (index < cut.efficient_below, "Efficient Transaction"),
        otherwise="Regional Baseline",
    )


def freight_bucket(freight_ratio: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return ladder(
        (freight_ratio <= cut.low_freight_up_to, "0-10% (Low)"),
        (freight_ratio <= cut.mid_freight_up_to, "10-20% (Mid)"),
        (freight_ratio <= cut.high_freight_up_to, "20-50% (High)"),
        otherwise="50%+ (Critical)",
    )


def installment_group(installments: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return ladder(
        (installments <= cut.single_pay_up_to, "Single Pay"),
        (installments <= cut.short_term_up_to, "Short-term (2-5)"),
        (installments <= cut.mid_term_up_to, "Mid-term (6-10)"),
        otherwise="Long-term (10+)",
    )


# Lanes


def transit_lane(seller_state: Column, customer_state: Column) -> Column:
    return F.concat(seller_state, F.lit(" -> "), customer_state)


def shipping_type(seller_region: Column, customer_region: Column) -> Column:
    return ladder((seller_region == customer_region, "Intra-Region"), otherwise="Cross-Region")


def dependency_segment(rank: Column, cut: Cutoffs = DEFAULTS) -> Column:
    return ladder(
        (rank <= cut.top_seller_rank, "High Dependency Seller (Top 5%)"),
        otherwise="Long Tail Seller",
    )


def lane_risk(
    late_items: Column, items: Column, score: Column, cut: Cutoffs = DEFAULTS
) -> Column:
    """The late share is compared by multiplying, as a lane always has items."""
    critical = late_items > items * F.lit(cut.critical_late_above)
    return ladder(
        (critical & (score < cut.critical_score_below), "Critical Risk Lane"),
        (late_items > items * F.lit(cut.bottleneck_late_above), "Logistical Bottleneck"),
        otherwise="Stable Lane",
    )
