"""Single scalar functions and business rules.

A rule query counts its labels over the whole table; a function query returns
the value of every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.catalog import oracle as sql
from mercato.catalog.oracle import percent, query
from mercato.catalog.registry import RetailWarehouse as W
from mercato.catalog.registry import add
from mercato.functions import dates, geography, rules
from mercato.functions.exact import MONEY, money, ratio
from mercato.functions.exact import percent as percent_of
from mercato.operators.statistics import figure
from mercato.plans import products


def labels(df: DataFrame, label: Column, name: str) -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("row_count"))


def label_sql(source: str, label: str, name: str) -> str:
    return query(f"SELECT {label} AS {name}, count(*) AS row_count FROM {source} GROUP BY ALL")


# Dates

_MONTH = "CAST(CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS VARCHAR)"

add(
    "func_month_start", "X01",
    lambda w: w.raw["orders"].select(
        "order_id", dates.month_of(F.col("order_purchase_timestamp")).alias("sales_month")
    ),
    query(f"SELECT order_id, {_MONTH} AS sales_month FROM raw_orders"),
)
add(
    "func_month_label", "X02",
    lambda w: w.raw["orders"].select(
        "order_id", dates.month_label(F.col("order_purchase_timestamp")).alias("label")
    ),
    query("SELECT order_id, strftime(order_purchase_timestamp, '%b %Y') AS label FROM raw_orders"),
)
add(
    "func_month_number", "X03",
    lambda w: labels(w.raw["orders"], F.month("order_purchase_timestamp"), "month"),
    label_sql("raw_orders", "CAST(month(order_purchase_timestamp) AS INTEGER)", "month"),
)
add(
    "func_whole_days", "X04",
    lambda w: w.raw["orders"].select(
        "order_id",
        dates.whole_days(
            F.col("order_purchase_timestamp"), F.col("order_estimated_delivery_date")
        ).alias("days"),
    ),
    query(
        """SELECT order_id, CAST(datesub('day', order_purchase_timestamp,
                                         order_estimated_delivery_date) AS INTEGER) AS days
        FROM raw_orders"""
    ),
)
add(
    "func_fractional_days", "X05 R06",
    lambda w: w.raw["orders"].select(
        "order_id",
        dates.fractional_days(
            F.col("order_purchase_timestamp"), F.col("order_estimated_delivery_date")
        ).alias("days"),
    ),
    query(
        """SELECT order_id, (epoch(order_estimated_delivery_date)
                             - epoch(order_purchase_timestamp)) / 86400.0 AS days
        FROM raw_orders"""
    ),
)
add(
    "func_days_between_dates", "X06",
    lambda w: w.dim_customers.select(
        "customer_unique_id",
        F.datediff(F.col("recent_order").cast("date"), F.col("first_order").cast("date")).alias(
            "days"
        ),
    ),
    query(
        """SELECT customer_unique_id,
               CAST(CAST(recent_order AS DATE) - CAST(first_order AS DATE) AS INTEGER) AS days
        FROM dim_customers"""
    ),
)
add(
    "func_date_minus_days", "X07",
    lambda w: w.raw["orders"].select(
        "order_id", F.date_sub(F.col("order_purchase_timestamp").cast("date"), 90).alias("before")
    ),
    query(
        """SELECT order_id, CAST(CAST(order_purchase_timestamp AS DATE) - 90 AS VARCHAR) AS before
        FROM raw_orders"""
    ),
)

# Types and numbers

add(
    "func_casts", "X08",
    lambda w: w.raw["payments"].select(
        "order_id",
        "payment_type",
        F.col("payment_installments").cast("bigint").alias("installments_big"),
        F.col("payment_value").cast("int").alias("whole_value"),
        F.col("payment_value").cast("decimal(18,4)").alias("fine_value"),
    ),
    query(
        """SELECT order_id, payment_type, CAST(payment_installments AS BIGINT) AS installments_big,
               CAST(trunc(payment_value) AS INTEGER) AS whole_value,
               CAST(payment_value AS DOUBLE) AS fine_value
        FROM raw_payments"""
    ),
)
add(
    "func_round", "X09",
    lambda w: w.raw["items"].select(
        "order_id", "order_item_id", "product_id",
        F.round(ratio(F.col("freight_value"), F.col("price")), 4).alias("four"),
        F.round(ratio(F.col("freight_value"), F.lit(8)), 2).alias("two"),
    ),
    query(
        f"""SELECT order_id, order_item_id, product_id,
               CASE WHEN price <> 0
                    THEN {sql.half_up(sql.cents("freight_value"), sql.cents("price"), 4)} END AS four,
               {sql.half_up(sql.cents("freight_value"), "800", 2)} AS two
        FROM raw_items"""
    ),
)
add(
    "func_coalesce", "X10",
    lambda w: w.dim_orders.select(
        "order_id", F.coalesce("max_installments", F.lit(0)).alias("installments")
    ),
    query("SELECT order_id, ifnull(max_installments, 0) AS installments FROM dim_orders"),
)
add(
    "func_nullif", "X11",
    lambda w: w.raw["items"].select(
        "order_id", "order_item_id", "product_id",
        F.nullif(F.col("price"), F.lit(0).cast("decimal(12,2)")).alias("charged"),
    ),
    query(
        """SELECT order_id, order_item_id, product_id,
               CASE WHEN price <> 0 THEN CAST(price AS DOUBLE) END AS charged
        FROM raw_items"""
    ),
)
add(
    "func_concat", "X12",
    lambda w: w.raw["products"].select(
        "product_id",
        F.concat("product_category_name", F.lit(" -> "), F.col("product_width_cm").cast("string"))
        .alias("joined"),
    ),
    query(
        """SELECT product_id, product_category_name || ' -> ' || product_width_cm AS joined
        FROM raw_products"""
    ),
)
add(
    "func_arithmetic", "X13",
    lambda w: w.raw["items"].select(
        "order_id", "order_item_id", "product_id",
        money(F.col("price") + F.col("freight_value")).alias("total"),
        money(F.col("price") - F.col("freight_value")).alias("net"),
        money(F.col("price") * 3).alias("triple"),
        percent_of(F.col("freight_value"), F.col("price") + F.col("freight_value")).alias("share"),
    ),
    query(
        f"""SELECT order_id, order_item_id, product_id,
               CAST(price + freight_value AS DOUBLE) AS total,
               CAST(price - freight_value AS DOUBLE) AS net, CAST(price * 3 AS DOUBLE) AS triple,
               {sql.half_up("100 * " + sql.cents("freight_value"),
                            f"nullif({sql.cents('price + freight_value')}, 0)")} AS share
        FROM raw_items"""
    ),
)
add(
    "func_conditional_count", "X14",
    lambda w: w.raw["orders"].agg(
        F.count_if(F.col("order_status") == "delivered").alias("delivered"),
        F.count_if(F.col("order_status") == "canceled").alias("canceled"),
        F.sum(rules.flag(F.col("order_delivered_customer_date").isNull())).alias("open"),
    ),
    query(
        """SELECT count(*) FILTER (WHERE order_status = 'delivered') AS delivered,
               count(*) FILTER (WHERE order_status = 'canceled') AS canceled,
               count(*) - count(order_delivered_customer_date) AS open
        FROM raw_orders"""
    ),
)

# Places and customers

add(
    "rule_state_name", "R01",
    lambda w: labels(
        w.raw["customers"], geography.state_name(F.col("customer_state")), "state_name"
    ),
    label_sql(
        "raw_customers LEFT JOIN geography ON code = customer_state",
        "coalesce(state, 'Unknown')", "state_name",
    ),
)
add(
    "rule_region", "R02 F05",
    lambda w: labels(w.raw["customers"], geography.region_of(F.col("customer_state")), "region"),
    query(
        """SELECT coalesce(geography.region, 'Unknown') AS region, count(*) AS row_count
        FROM raw_customers LEFT JOIN geography ON code = customer_state GROUP BY ALL"""
    ),
)
add(
    "rule_repeat_buyer", "R03",
    lambda w: labels(w.dim_customers, F.col("is_repeat_buyer"), "is_repeat_buyer"),
    label_sql("dim_customers", "is_repeat_buyer", "is_repeat_buyer"),
)
add(
    "rule_returned_within_90_days", "R10",
    lambda w: labels(w.customer_journey, F.col("is_returned_90d"), "is_returned_90d"),
    label_sql("journey", "is_returned_90d", "is_returned_90d"),
)
add(
    "rule_churned", "R11",
    lambda w: labels(w.customer_journey, F.col("is_churned"), "is_churned"),
    label_sql("journey", "is_churned", "is_churned"),
)
add(
    "rule_recovery_priority", "R12",
    lambda w: labels(w.winback_segmentation, F.col("recovery_priority"), "recovery_priority"),
    label_sql("winback", "recovery_priority", "recovery_priority"),
)

# Products

add(
    "rule_category_name", "R04",
    lambda w: labels(w.dim_products, F.col("product_category"), "product_category"),
    label_sql("dim_products", "product_category", "product_category"),
)
add(
    "rule_size_bucket", "R05",
    lambda w: labels(w.dim_products, rules.size_bucket(F.col("volume_cm3")), "bucket"),
    label_sql("dim_products", sql.size_bucket("volume_cm3"), "bucket"),
)
add(
    "rule_pareto_segment", "R13",
    lambda w: labels(w.product_quality_matrix, F.col("revenue_segment"), "revenue_segment"),
    label_sql(
        "category_shares",
        "if(share <= 0.8, 'Pareto Driver (Top 80%)', 'Long Tail')",
        "revenue_segment",
    ),
)
add(
    "rule_quadrant", "R14",
    lambda w: labels(w.product_quality_matrix, F.col("matrix_position"), "matrix_position"),
    label_sql("matrix", "matrix_position", "matrix_position"),
)
add(
    "rule_lifecycle", "R15",
    lambda w: labels(w.product_quality_matrix, F.col("lifecycle_status"), "lifecycle_status"),
    label_sql("matrix", "lifecycle_status", "lifecycle_status"),
)


def _bands(w: W) -> DataFrame:
    last_day, day = figure(w.fct_plain, F.max("purchase_date")), F.col("purchase_date")
    value = F.col("item_total_value")
    banded = w.fct_plain.withColumns(
        {
            "recent": F.when(rules.recent_band(day, last_day), value),
            "previous": F.when(rules.previous_band(day, last_day), value),
        }
    )
    return banded.agg(
        *[
            expression
            for band in ("recent", "previous")
            for expression in (
                F.count(band).alias(f"{band}_items"),
                F.sum(band).cast(MONEY).alias(f"{band}_value"),
            )
        ]
    )


add(
    "rule_time_bands", "R16 X07",
    _bands,
    query(
        """SELECT count(*) FILTER (WHERE age <= 90) AS recent_items,
               CAST(sum(item_total_value) FILTER (WHERE age <= 90) AS DOUBLE) AS recent_value,
               count(*) FILTER (WHERE age BETWEEN 91 AND 180) AS previous_items,
               CAST(sum(item_total_value) FILTER (WHERE age BETWEEN 91 AND 180) AS DOUBLE)
                   AS previous_value
        FROM (SELECT item_total_value, (SELECT d FROM last_day) - purchase_date AS age
              FROM fct_plain)"""
    ),
)
add(
    "rule_filled_category", "R20",
    lambda w: labels(w.dim_products, rules.filled_category(F.col("product_category")), "category"),
    label_sql(
        "dim_products",
        "CASE WHEN product_category <> '' THEN product_category ELSE 'Uncategorized' END",
        "category",
    ),
)
add(
    "rule_toxicity", "R24",
    lambda w: products.category_metrics(w.fct_plain, w.dim_products, w.dim_orders).select(
        "product_category",
        rules.toxicity_percent(F.col("one_star_count"), F.col("total_reviews")).alias("toxicity"),
    ),
    query(
        f"""SELECT product_category, {percent("one_star_count", "total_reviews")} AS toxicity
        FROM category_sums"""
    ),
)

# Delivery and growth

add(
    "rule_delivery_flags", "R06",
    lambda w: w.raw["orders"]
    .groupBy(
        rules.late(
            F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
        ).alias("is_late"),
        rules.delivered(F.col("order_status")).alias("is_delivered"),
    )
    .agg(F.count(F.lit(1)).alias("row_count")),
    query(
        """SELECT CAST(ifnull(order_delivered_customer_date > order_estimated_delivery_date, false)
                       AS INTEGER) AS is_late,
               CAST(order_status = 'delivered' AS INTEGER) AS is_delivered, count(*) AS row_count
        FROM raw_orders GROUP BY ALL"""
    ),
)
add(
    "rule_growth_class", "R07",
    lambda w: labels(w.monthly_growth, F.col("growth_classification"), "growth_classification"),
    label_sql("growth", "growth_classification", "growth_classification"),
)
add(
    "rule_calendar_event", "R08",
    lambda w: labels(
        w.raw["orders"], rules.calendar_event(F.col("order_purchase_timestamp")), "event"
    ),
    label_sql("raw_orders", sql.event("order_purchase_timestamp"), "event"),
)
add(
    "rule_health_status", "R09",
    lambda w: w.executive_summary.select("sales_month", "business_health_status"),
    query(
        """SELECT CAST(sales_month AS VARCHAR) AS sales_month, business_health_status
        FROM executive"""
    ),
)

# Freight, payments and lanes

add(
    "rule_efficiency_status", "R17",
    lambda w: labels(
        w.unit_economics, F.col("transaction_efficiency_status"), "transaction_efficiency_status"
    ),
    label_sql("economics", "transaction_efficiency_status", "transaction_efficiency_status"),
)
add(
    "rule_freight_bucket", "R18",
    lambda w: labels(
        w.raw["items"],
        rules.freight_bucket(F.round(ratio(F.col("freight_value"), F.col("price")), 4)),
        "bucket",
    ),
    query(
        f"""SELECT {sql.freight_bucket("r")} AS bucket, count(*) AS row_count
        FROM (SELECT CASE WHEN price <> 0
                     THEN {sql.half_up(sql.cents("freight_value"), sql.cents("price"), 4)} END AS r
              FROM raw_items) GROUP BY ALL"""
    ),
)
add(
    "rule_installment_group", "R19",
    lambda w: labels(
        w.dim_orders, rules.installment_group(F.col("max_installments")), "installment_group"
    ),
    label_sql("dim_orders", sql.installments("max_installments"), "installment_group"),
)
add(
    "rule_shipping_type", "R21",
    lambda w: labels(w.strategic_risk_map, F.col("shipping_type"), "shipping_type"),
    label_sql("risk_map", "shipping_type", "shipping_type"),
)
add(
    "rule_dependency_segment", "R22",
    lambda w: labels(w.strategic_risk_map, F.col("dependency_segment"), "dependency_segment"),
    label_sql("risk_map", "dependency_segment", "dependency_segment"),
)
add(
    "rule_lane_risk", "R23",
    lambda w: labels(w.strategic_risk_map, F.col("strategic_risk_status"), "strategic_risk_status"),
    label_sql("risk_map", "strategic_risk_status", "strategic_risk_status"),
)
