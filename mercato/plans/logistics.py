"""Freight cost of each order item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.exact import ratio
from mercato.operators.joins import large_join
from mercato.operators.statistics import with_label_sums


def unit_economics(
    fct: DataFrame,
    orders: DataFrame,
    sellers: DataFrame,
    cut: rules.Cutoffs = rules.DEFAULTS,
) -> DataFrame:
    """Freight ratio, index against the seller region, and three groupings."""
    places = sellers.select("seller_id", "seller_state", "brazil_region")
    # Freight is added up per seller before sellers are looked up.
    per_seller = (
        fct.groupBy("seller_id")
        .agg(F.sum("freight_value").alias("_freight"), F.count("freight_value").alias("_priced"))
        .join(places, "seller_id", "left")
    )
    paid = orders.select(
        "order_id",
        F.nullif(F.col("review_score"), F.lit(-1)).alias("review_score"),
        "max_installments",
        "total_order_payment_value",
    )
    sold = fct.select("sales_key", "order_id", "seller_id", "price", "freight_value")
    lines = large_join(sold, paid, "order_id", "left").join(places, "seller_id", "left")
    freight, total, priced = F.col("freight_value"), F.col("_freight"), F.col("_priced")
    return (
        with_label_sums(lines, "brazil_region", per_seller, "_freight", "_priced")
        .withColumns(
            {
                "regional_avg_freight": ratio(total, priced),
                "freight_ratio": F.round(ratio(freight, F.col("price")), 4),
                # Freight over the mean, without rounding the mean first.
                "regional_efficiency_index": F.round(ratio(freight * priced, total), 2),
            }
        )
        .select(
            "sales_key",
            "price",
            "freight_value",
            "review_score",
            "max_installments",
            "total_order_payment_value",
            "seller_state",
            "brazil_region",
            "regional_avg_freight",
            "freight_ratio",
            "regional_efficiency_index",
            rules.efficiency_status(F.col("regional_efficiency_index"), cut).alias(
                "transaction_efficiency_status"
            ),
            rules.freight_bucket(F.col("freight_ratio"), cut).alias("freight_ratio_bucket"),
            rules.installment_group(F.col("max_installments"), cut).alias("installment_group"),
        )
    )
