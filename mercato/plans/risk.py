"""Seller concentration and transit-lane risk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.exact import MONEY, mean, percent
from mercato.operators.joins import large_join, name_numbers, names_of_numbers, numbered_names
from mercato.operators.ranking import Writer, percent_rank_desc

LANE_KEYS = [
    "product_category",
    "seller_id",
    "seller_state",
    "seller_region",
    "customer_state",
    "customer_region",
]


#: Numbers of a lane's names, and the names each of them stands for.
PLACES = {
    "customer_place": ["customer_state", "customer_region"],
    "seller_place": ["seller_state", "seller_region"],
}
MEASURES = [
    "seller_category_revenue",
    "total_category_orders",
    "avg_lane_review",
    "total_late_orders",
]

# The fact with columns of customers, given by ``customer_unique_id``; null for other customers.
WithPeople = Callable[[DataFrame], DataFrame]


def seller_lanes(
    fct: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    with_people: WithPeople | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Items per category, seller and customer state; unmatched items drop out.

    The order join comes first, as a fact built from orders is already
    partitioned by order; customers come before it where ``with_people`` gives
    ``fct`` with columns of theirs. Sellers have one row each, so they are looked up
    after the items have been added up per seller. States and regions travel
    as a number; ``numbered`` keeps the numbers beside the names.
    """
    targets = customers.where(F.col("customer_unique_id").isNotNull()).select(
        "customer_unique_id", "customer_state", F.col("brazil_region").alias("customer_region")
    )
    origins = sellers.select(
        "seller_id", "seller_state", F.col("brazil_region").alias("seller_region")
    )
    names = PLACES["customer_place"]
    places = numbered_names(targets, names, "customer_place")
    people = name_numbers(targets, places, names, "customer_place").drop(*names)
    sold = ["order_id", "product_id", "seller_id", "item_total_value", "is_late"]
    scores = orders.select("order_id", "review_score")
    if with_people:
        located = with_people(people).where(F.col("customer_place").isNotNull())
        scored = large_join(located.select(*sold, "customer_place"), scores, "order_id")
    else:
        bought = fct.select(*sold, "customer_unique_id")
        scored = large_join(
            large_join(bought, scores, "order_id"), people, "customer_unique_id"
        )
    category = rules.filled_category(F.col("product_category")).alias("product_category")
    lines = scored.join(products.select("product_id", category), "product_id")
    lanes = lines.groupBy("product_category", "seller_id", "customer_place").agg(
        F.sum("item_total_value").cast(MONEY).alias("seller_category_revenue"),
        # An order id is never null behind its join; uncounted, it is not shuffled any further.
        F.count(F.lit(1)).alias("total_category_orders"),
        mean(F.nullif(F.col("review_score"), F.lit(-1))).alias("avg_lane_review"),
        F.sum("is_late").alias("total_late_orders"),
    )
    lanes = names_of_numbers(lanes.join(origins, "seller_id"), places, "customer_place")
    if numbered:
        names = PLACES["seller_place"]
        known = numbered_names(origins, names, "seller_place")
        lanes = name_numbers(lanes, known, names, "seller_place")
    return lanes.select(*LANE_KEYS, *MEASURES, *(PLACES if numbered else ()))


def strategic_risk_map(
    fct: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    cut: rules.Cutoffs = rules.DEFAULTS,
    write: Writer | None = None,
    with_people: WithPeople | None = None,
) -> DataFrame:
    """Lanes with their revenue rank in the category and risk labels.

    The lanes are read twice; ``write`` keeps them, so that they are built once. Their
    ranks are then joined without the names of the places, which the written lanes
    give back, and in an order in which equal values follow each other.
    """
    lanes = seller_lanes(fct, products, sellers, customers, orders, with_people, bool(write))
    kept = {}
    if write:
        near = ["product_category", *PLACES, "total_late_orders", "avg_lane_review"]
        lanes = write(lanes.sortWithinPartitions(*near), "ranked-rows")
        kept = {number: lanes.select(number, *names).distinct() for number, names in PLACES.items()}
        lanes = lanes.drop(*(name for names in PLACES.values() for name in names))
    ranked = percent_rank_desc(
        lanes, "product_category", "seller_category_revenue", "seller_revenue_rank"
    )
    for number, names in kept.items():
        ranked = names_of_numbers(ranked, names, number)
    late_items, items = F.col("total_late_orders"), F.col("total_category_orders")
    return ranked.select(
        *LANE_KEYS,
        *MEASURES,
        "seller_revenue_rank",
        rules.transit_lane(F.col("seller_state"), F.col("customer_state")).alias("transit_lane"),
        rules.shipping_type(F.col("seller_region"), F.col("customer_region")).alias(
            "shipping_type"
        ),
        rules.dependency_segment(F.col("seller_revenue_rank"), cut).alias("dependency_segment"),
        percent(late_items, items).alias("lane_late_rate_pct"),
        rules.lane_risk(late_items, items, F.col("avg_lane_review"), cut).alias(
            "strategic_risk_status"
        ),
    )
