"""Single filters, joins, aggregates, windows, sorts and subqueries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.catalog.oracle import cents, half_up, in_range, query, rounded, table
from mercato.catalog.registry import RetailWarehouse as W
from mercato.catalog.registry import add
from mercato.functions.exact import MONEY, money, money_mean, money_mean_over, ratio
from mercato.operators.cumulative import running_total_desc
from mercato.operators.durable import written
from mercato.operators.ranking import first_rows, ordered_index, percent_rank_desc
from mercato.operators.statistics import figure, with_label_sums
from mercato.plans import customers, executive, growth, products, risk, staging

# Filters and projections

add(
    "filter_date_range",
    "F01",
    lambda w: growth.in_range(w.fct_plain, w.start, w.end)
    .groupBy("purchase_date")
    .agg(F.count(F.lit(1)).alias("items")),
    query(
        f"""SELECT CAST(purchase_date AS VARCHAR) AS purchase_date, count(*) AS items
        FROM fct_plain WHERE {in_range("purchase_date")} GROUP BY ALL"""
    ),
)
add(
    "filter_canceled_orders",
    "F02",
    lambda w: w.raw["orders"]
    .where(F.col("order_status") == "canceled")
    .select("order_id", "order_status", "order_purchase_timestamp"),
    query(
        """SELECT order_id, order_status,
               CAST(order_purchase_timestamp AS VARCHAR) AS order_purchase_timestamp
        FROM raw_orders WHERE order_status = 'canceled'"""
    ),
)


def _worthy_churned(w: W):
    journey = w.customer_journey
    worth = F.col("total_lifetime_revenue")
    return journey.where(
        (F.col("is_churned") == 1) & (worth > figure(journey, money_mean(worth)))
    ).select("customer_unique_id", "recency_days", "total_lifetime_revenue")


add(
    "filter_churned_above_mean",
    "F03 W08",
    _worthy_churned,
    query(
        """SELECT customer_unique_id, recency_days,
               CAST(total_lifetime_revenue AS DOUBLE) AS total_lifetime_revenue
        FROM journey WHERE is_churned = 1
          AND total_lifetime_revenue > (SELECT avg(total_lifetime_revenue) FROM journey)"""
    ),
)
add(
    "filter_known_region",
    "F05",
    lambda w: w.dim_sellers.where(F.col("brazil_region").isin("North", "South")),
    query("SELECT * FROM dim_sellers WHERE brazil_region = 'North' OR brazil_region = 'South'"),
)
add(
    "filter_null_delivery",
    "F06",
    lambda w: w.raw["orders"]
    .groupBy("order_status")
    .agg(
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("open"),
        F.count_if(F.col("order_delivered_customer_date").isNotNull()).alias("arrived"),
    ),
    query(
        """SELECT order_status, count(*) - count(order_delivered_customer_date) AS open,
               count(order_delivered_customer_date) AS arrived
        FROM raw_orders GROUP BY ALL"""
    ),
)
add(
    "project_all_plus_derived",
    "F07 F08",
    lambda w: w.raw["items"].select(
        "*",
        F.col("order_item_id").alias("item_sequence_number"),
        money(F.col("price") + F.col("freight_value")).alias("item_total_value"),
    ),
    query(
        """SELECT * REPLACE (CAST(price AS DOUBLE) AS price,
                             CAST(freight_value AS DOUBLE) AS freight_value),
               order_item_id AS item_sequence_number,
               CAST(price + freight_value AS DOUBLE) AS item_total_value
        FROM raw_items"""
    ),
)

# Joins


def _match_counts(joined, *labels: str):
    """Rows, and rows with a partner, of a left join."""
    return joined.agg(
        F.count(F.lit(1)).alias("all_rows"),
        *[F.count(label).alias(f"with_{label}") for label in labels],
    )


add(
    "join_customers_orders",
    "J01",
    lambda w: w.raw["customers"]
    .join(w.raw["orders"], "customer_id", "left")
    .select("customer_id", "customer_unique_id", "order_id", "order_status"),
    query(
        """SELECT c.customer_id, customer_unique_id, order_id, order_status
        FROM raw_customers c LEFT JOIN raw_orders o ON c.customer_id = o.customer_id"""
    ),
)
add(
    "join_orders_payments",
    "J02",
    lambda w: w.raw["orders"]
    .join(staging.order_payments(w.raw["payments"]), "order_id", "left")
    .select("order_id", "total_order_payment_value", "primary_payment_type", "max_installments"),
    query(
        """SELECT order_id, CAST(total_order_payment_value AS DOUBLE) AS total_order_payment_value,
               primary_payment_type, max_installments
        FROM raw_orders LEFT JOIN payment_sums USING (order_id)"""
    ),
)
add(
    "join_orders_reviews",
    "J03",
    lambda w: w.raw["orders"]
    .join(staging.order_scores(w.raw["reviews"]), "order_id", "left")
    .select("order_id", "review_score"),
    query("SELECT order_id, review_score FROM raw_orders LEFT JOIN score_means USING (order_id)"),
)
add(
    "join_orders_baskets",
    "J04 X10",
    lambda w: w.raw["orders"]
    .join(staging.order_baskets(w.raw["items"]), "order_id", "left")
    .select("order_id", F.coalesce("basket_size", F.lit(0)).alias("basket_size")),
    query(
        """SELECT order_id, coalesce(basket_size, 0) AS basket_size
        FROM raw_orders LEFT JOIN baskets USING (order_id)"""
    ),
)
add(
    "join_products_translation",
    "J05",
    lambda w: w.raw["products"]
    .join(w.raw["translation"], "product_category_name", "left")
    .select("product_id", "product_category_name", "product_category_name_english"),
    query(
        """SELECT product_id, p.product_category_name, product_category_name_english
        FROM raw_products p LEFT JOIN raw_translation t
             ON p.product_category_name = t.product_category_name"""
    ),
)
add(
    "join_items_orders",
    "J06",
    lambda w: w.raw["items"]
    .join(w.raw["orders"], "order_id", "left")
    .groupBy("order_status")
    .agg(F.count(F.lit(1)).alias("items"), F.sum("price").cast(MONEY).alias("value")),
    query(
        """SELECT order_status, count(*) AS items, CAST(sum(price) AS DOUBLE) AS value
        FROM raw_items LEFT JOIN raw_orders USING (order_id) GROUP BY ALL"""
    ),
)
add(
    "join_orders_customers",
    "J07",
    lambda w: w.raw["orders"]
    .join(w.raw["customers"], "customer_id", "left")
    .select("order_id", "customer_unique_id", "customer_state"),
    query(
        """SELECT order_id, customer_unique_id, customer_state
        FROM raw_orders LEFT JOIN raw_customers USING (customer_id)"""
    ),
)
add(
    "join_fact_canceled_orders",
    "J08",
    lambda w: w.fct_plain.join(
        w.dim_orders.where(F.col("order_status") == "canceled").select("order_id"), "order_id"
    ).select("order_id", "item_sequence_number", "product_id", "item_total_value"),
    query(
        """SELECT order_id, item_sequence_number, product_id,
               CAST(item_total_value AS DOUBLE) AS item_total_value
        FROM fct_plain JOIN dim_orders USING (order_id) WHERE order_status = 'canceled'"""
    ),
)


def _month_join(w: W, right):
    months = growth.month_totals(w.fct_plain, w.start, w.end)
    return months.select("sales_month", "total_orders").join(
        F.broadcast(right), "sales_month", "left"
    )


add(
    "join_months_sentiment",
    "J09",
    lambda w: _month_join(w, executive.month_sentiment(w.dim_orders, w.start, w.end)).select(
        "sales_month", "total_orders", "total_order_volume"
    ),
    query(
        """SELECT CAST(sales_month AS VARCHAR) AS sales_month, total_orders, total_order_volume
        FROM month_totals LEFT JOIN sentiment USING (sales_month)"""
    ),
)
add(
    "join_months_lost_revenue",
    "J10",
    lambda w: _month_join(w, executive.canceled_revenue(w.fct_plain, w.dim_orders)),
    query(
        """SELECT CAST(sales_month AS VARCHAR) AS sales_month, total_orders,
               CAST(canceled_revenue_loss AS DOUBLE) AS canceled_revenue_loss
        FROM month_totals LEFT JOIN leakage USING (sales_month)"""
    ),
)
add(
    "join_customers_stats",
    "J11",
    lambda w: w.dim_customers.join(
        customers.customer_stats(w.fct_plain), "customer_unique_id"
    ).select("customer_unique_id", "is_repeat_buyer", "total_lifetime_orders"),
    query(
        """SELECT customer_unique_id, is_repeat_buyer, total_lifetime_orders
        FROM dim_customers JOIN buyer_stats USING (customer_unique_id)"""
    ),
)


def _recency(w: W):
    last_day = figure(w.fct_plain, F.max("purchase_date"))
    return w.dim_customers.select(
        "customer_unique_id",
        F.datediff(last_day, F.col("recent_order").cast("date")).alias("recency_days"),
    )


add(
    "join_last_day",
    "J12 A11 X06",
    _recency,
    query(
        """SELECT customer_unique_id, CAST(d - CAST(recent_order AS DATE) AS INTEGER) AS recency_days
        FROM dim_customers, last_day"""
    ),
)
add(
    "join_two_touches",
    "J13",
    lambda w: w.dim_customers.select("customer_unique_id").join(
        customers.first_touches(w.fct_plain), "customer_unique_id", "left"
    ),
    query(
        """SELECT customer_unique_id, first_order_id,
               CAST(second_order_date AS VARCHAR) AS second_order_date
        FROM dim_customers LEFT JOIN touches USING (customer_unique_id)"""
    ),
)
add(
    "join_first_touch_score",
    "J14",
    lambda w: customers.first_touches(w.fct_plain)
    .join(
        w.dim_orders.select(F.col("order_id").alias("first_order_id"), "review_score"),
        "first_order_id",
        "left",
    )
    .select("customer_unique_id", "first_order_id", "review_score"),
    query(
        """SELECT customer_unique_id, first_order_id, review_score
        FROM touches LEFT JOIN dim_orders ON order_id = first_order_id"""
    ),
)
add(
    "join_fact_products_orders",
    "J15",
    lambda w: w.fct_plain.join(w.dim_products, "product_id")
    .join(w.dim_orders.select("order_id", "review_score"), "order_id")
    .groupBy("product_category", "volume_category")
    .agg(F.count(F.lit(1)).alias("items"), F.count("review_score").alias("scored")),
    query(
        """SELECT product_category, volume_category, count(*) AS items,
               count(review_score) AS scored
        FROM fct_plain JOIN dim_products USING (product_id)
        JOIN dim_orders USING (order_id) GROUP BY ALL"""
    ),
)
add(
    "join_category_growth",
    "J16",
    lambda w: products.category_metrics(w.fct_plain, w.dim_products, w.dim_orders)
    .where(F.col("product_category").isNotNull())
    .select("product_category", "total_revenue", "recent_rev", "prev_rev"),
    query(
        """SELECT product_category, CAST(total_revenue AS DOUBLE) AS total_revenue,
               CAST(recent_rev AS DOUBLE) AS recent_rev, CAST(prev_rev AS DOUBLE) AS prev_rev
        FROM category_shares"""
    ),
)
add(
    "join_fact_orders_sellers",
    "J17",
    lambda w: _match_counts(
        w.fct_plain.join(w.dim_orders, "order_id", "left").join(
            w.dim_sellers, "seller_id", "left"
        ),
        "review_score",
        "max_installments",
        "seller_state",
    ),
    query(
        """SELECT count(*) AS all_rows, count(review_score) AS with_review_score,
               count(max_installments) AS with_max_installments,
               count(seller_state) AS with_seller_state
        FROM fct_plain LEFT JOIN dim_orders USING (order_id)
        LEFT JOIN dim_sellers USING (seller_id)"""
    ),
)
add(
    "join_star",
    "J18 A15 A16",
    lambda w: risk.seller_lanes(
        w.fct_plain, w.dim_products, w.dim_sellers, w.dim_customers, w.dim_orders
    )
    .groupBy("seller_region", "customer_region")
    .agg(
        F.count(F.lit(1)).alias("lanes"),
        F.sum("total_category_orders").alias("items"),
        F.sum("seller_category_revenue").cast(MONEY).alias("revenue"),
    ),
    query(
        """SELECT seller_region, customer_region, count(*) AS lanes,
               CAST(sum(total_category_orders) AS BIGINT) AS items,
               CAST(sum(seller_category_revenue) AS DOUBLE) AS revenue
        FROM lanes GROUP BY ALL"""
    ),
)

# Aggregates

add(
    "agg_customer_extremes",
    "A01",
    lambda w: w.dim_customers.select(
        "customer_unique_id", "customer_city", "first_order", "recent_order"
    ),
    query(
        """SELECT customer_unique_id, customer_city, CAST(first_order AS VARCHAR) AS first_order,
               CAST(recent_order AS VARCHAR) AS recent_order FROM dim_customers"""
    ),
)
add(
    "agg_order_payments",
    "A02",
    lambda w: staging.order_payments(w.raw["payments"]),
    table("payment_sums", doubles="total_order_payment_value"),
)
add(
    "agg_order_scores",
    "A03 X10",
    lambda w: staging.order_scores(w.raw["reviews"]),
    table("score_means"),
)
add(
    "agg_order_baskets",
    "A04",
    lambda w: staging.order_baskets(w.raw["items"]),
    table("baskets"),
)
add(
    "agg_seller_places",
    "A05",
    lambda w: w.raw["sellers"]
    .groupBy("seller_state")
    .agg(F.max("seller_city").alias("last_city"), F.count(F.lit(1)).alias("sellers")),
    query(
        """SELECT seller_state, max(seller_city) AS last_city, count(*) AS sellers
        FROM raw_sellers GROUP BY ALL"""
    ),
)
add(
    "agg_month_totals",
    "A06 A16",
    lambda w: growth.month_totals(w.fct_plain, w.start, w.end),
    table(
        "month_totals",
        days="sales_month",
        doubles="current_month_sale current_month_freight current_month_revenue",
    ),
)
add(
    "agg_day_totals",
    "A07 A16",
    lambda w: growth.revenue_totals(
        growth.in_range(w.fct_plain, w.start, w.end).withColumnRenamed(
            "purchase_date", "sales_date"
        ),
        "sales_date",
        "current_day",
    ).drop("late_deliveries"),
    table(
        "day_totals",
        days="sales_date",
        doubles="current_day_sale current_day_freight current_day_revenue",
    ),
)
add(
    "agg_month_sentiment",
    "A08 W06 X14",
    lambda w: executive.month_sentiment(w.dim_orders, w.start, w.end),
    query(
        f"""SELECT CAST(sales_month AS VARCHAR) AS sales_month,
               {rounded("mean_score", 6)} AS avg_review_score,
               {rounded("mean_score_before", 6)} AS prev_month_sentiment,
               delivered_count, canceled_count, total_order_volume FROM sentiment"""
    ),
)
add(
    "agg_canceled_revenue",
    "A09",
    lambda w: executive.canceled_revenue(w.fct_plain, w.dim_orders),
    table(
        "leakage", days="sales_month", doubles="canceled_revenue_loss", drop="canceled_price_loss"
    ),
)
add(
    "agg_customer_stats",
    "A10",
    lambda w: customers.customer_stats(w.fct_plain),
    table("buyer_stats", doubles="total_lifetime_revenue"),
)
add(
    "agg_last_day",
    "A11 Q03",
    lambda w: w.fct_plain.agg(F.max("purchase_date").alias("last_day")),
    query("SELECT CAST(d AS VARCHAR) AS last_day FROM last_day"),
)
add(
    "agg_category_metrics",
    "A12 A13",
    lambda w: products.category_metrics(w.fct_plain, w.dim_products, w.dim_orders),
    query(
        f"""SELECT * EXCLUDE (mean_score)
                 REPLACE (CAST(total_revenue AS DOUBLE) AS total_revenue,
                          CAST(recent_rev AS DOUBLE) AS recent_rev,
                          CAST(prev_rev AS DOUBLE) AS prev_rev),
               {rounded("mean_score", 6)} AS avg_review_score
        FROM category_sums"""
    ),
)
add(
    "agg_mean_category_revenue",
    "A14",
    lambda w: products.category_metrics(w.fct_plain, w.dim_products, w.dim_orders).agg(
        F.round(money_mean(F.col("total_revenue")), 2).alias("mean_revenue")
    ),
    query(f"SELECT {rounded('avg(total_revenue)')} AS mean_revenue FROM category_sums"),
)
add(
    "agg_seller_lanes",
    "A15 A16",
    lambda w: risk.seller_lanes(
        w.fct_plain, w.dim_products, w.dim_sellers, w.dim_customers, w.dim_orders
    ),
    query(
        f"""SELECT * EXCLUDE (mean_score)
                 REPLACE (CAST(seller_category_revenue AS DOUBLE) AS seller_category_revenue),
               {rounded("mean_score", 6)} AS avg_lane_review
        FROM lanes"""
    ),
)

# Windows

add(
    "window_global_row_number",
    "W01",
    lambda w: ordered_index(w.raw["items"], staging.ITEM_ORDER, "sales_key").select(
        "sales_key", "order_id", "order_item_id", "product_id"
    ),
    query(
        """SELECT row_number() OVER (ORDER BY order_id, order_item_id, product_id, seller_id,
                                           price, freight_value) AS sales_key,
               order_id, order_item_id, product_id FROM raw_items"""
    ),
)


def _months(w: W):
    return growth.month_totals(w.fct_plain, w.start, w.end).select(
        "sales_month", "current_month_revenue"
    )


add(
    "window_lag_revenue",
    "W02",
    lambda w: _months(w).withColumn(
        "prev_month_revenue",
        F.lag("current_month_revenue").over(Window.orderBy("sales_month")),
    ),
    query(
        """SELECT CAST(sales_month AS VARCHAR) AS sales_month,
               CAST(current_month_revenue AS DOUBLE) AS current_month_revenue,
               CAST(prev_month_revenue AS DOUBLE) AS prev_month_revenue FROM month_steps"""
    ),
)
add(
    "window_trailing_three_months",
    "W03",
    lambda w: _months(w).select(
        "sales_month",
        money(
            money_mean_over(
                F.col("current_month_revenue"), Window.orderBy("sales_month").rowsBetween(-3, -1)
            )
        ).alias("trailing_avg_3m"),
    ),
    query(
        f"""SELECT CAST(sales_month AS VARCHAR) AS sales_month,
               {rounded("rolling")} AS trailing_avg_3m FROM month_steps"""
    ),
)
add(
    "window_trailing_mean_30_days",
    "W04",
    lambda w: w.daily_volatility.select("sales_date", "revenue_average_30d"),
    query(
        """SELECT CAST(sales_date AS VARCHAR) AS sales_date, revenue_average_30d
        FROM volatility"""
    ),
)
add(
    "window_trailing_deviation_30_days",
    "W05",
    lambda w: w.daily_volatility.select("sales_date", "revenue_volatility_30d"),
    query(
        """SELECT CAST(sales_date AS VARCHAR) AS sales_date, revenue_volatility_30d
        FROM volatility"""
    ),
)
add(
    "window_lag_sentiment",
    "W06",
    lambda w: executive.month_sentiment(w.dim_orders, w.start, w.end).select(
        "sales_month", "prev_month_sentiment"
    ),
    query(
        f"""SELECT CAST(sales_month AS VARCHAR) AS sales_month,
               {rounded("mean_score_before", 6)} AS prev_month_sentiment FROM sentiment"""
    ),
)


def _two_first_rows(w: W):
    order = [F.col(c) for c in ("purchase_date", "order_id", "item_sequence_number", "product_id")]
    bought = w.fct_plain.select(
        "customer_unique_id", "purchase_date", "order_id", "item_sequence_number", "product_id"
    )
    return first_rows(bought, "customer_unique_id", order, 2, "order_seq")


add(
    "window_first_two_rows",
    "W07 S02 F04 Q02",
    _two_first_rows,
    query(
        """SELECT customer_unique_id, CAST(purchase_date AS VARCHAR) AS purchase_date, order_id,
               item_sequence_number, product_id,
               CAST(row_number() OVER w AS INTEGER) AS order_seq
        FROM fct_plain
        WINDOW w AS (PARTITION BY customer_unique_id
                     ORDER BY purchase_date, order_id, item_sequence_number, product_id)
        QUALIFY row_number() OVER w <= 2"""
    ),
)


def _against_mean(w: W):
    stats = customers.customer_stats(w.fct_plain)
    worth = F.col("total_lifetime_revenue")
    return stats.select(
        "customer_unique_id",
        money(worth - figure(stats, money_mean(worth))).alias("above_mean"),
    )


add(
    "window_global_mean",
    "W08",
    _against_mean,
    query(
        f"""SELECT customer_unique_id,
               {rounded("CAST(total_lifetime_revenue AS DOUBLE) - avg(total_lifetime_revenue) OVER ()")}
                   AS above_mean FROM buyer_stats"""
    ),
)


def _category_windows(w: W):
    metrics = products.category_metrics(w.fct_plain, w.dim_products, w.dim_orders)
    named = written(metrics.where(F.col("product_category").isNotNull()), "categories")
    return running_total_desc(named, "total_revenue", "running_total").select(
        "product_category",
        figure(named, F.sum("total_revenue")).alias("global_total"),
        "running_total",
    )


add(
    "window_cumulative_revenue",
    "W09 W10",
    _category_windows,
    query(
        """SELECT product_category,
               CAST(sum(total_revenue) OVER () AS DOUBLE) AS global_total,
               CAST(sum(total_revenue) OVER (ORDER BY total_revenue DESC) AS DOUBLE) AS running_total
        FROM category_shares"""
    ),
)


def _regional_mean(w: W):
    lines = w.fct_plain.join(w.dim_sellers, "seller_id", "left").select(
        "order_id", "item_sequence_number", "product_id", "brazil_region", "freight_value"
    )
    sums = lines.groupBy("brazil_region").agg(
        F.sum("freight_value").alias("total"), F.count("freight_value").alias("items")
    )
    return (
        with_label_sums(lines, "brazil_region", sums, "total", "items")
        .withColumn("regional_avg_freight", ratio(F.col("total"), F.col("items")))
        .drop("total", "items")
    )


add(
    "window_regional_mean",
    "W11",
    _regional_mean,
    query(
        f"""SELECT order_id, item_sequence_number, product_id, brazil_region,
               CAST(freight_value AS DOUBLE) AS freight_value,
               {half_up(f"sum({cents('freight_value')}) OVER region", "(100 * count(*) OVER region)", 6)}
                   AS regional_avg_freight
        FROM fct_plain LEFT JOIN dim_sellers USING (seller_id)
        WINDOW region AS (PARTITION BY brazil_region)"""
    ),
)
add(
    "window_percent_rank",
    "W12",
    lambda w: percent_rank_desc(
        w.fct_plain.select("order_id", "item_sequence_number", "product_id", "seller_id", "price"),
        "seller_id",
        "price",
        "price_rank",
    ),
    query(
        """SELECT order_id, item_sequence_number, product_id, seller_id,
               CAST(price AS DOUBLE) AS price,
               percent_rank() OVER (PARTITION BY seller_id ORDER BY price DESC) AS price_rank
        FROM fct_plain"""
    ),
)

# Sorts and subqueries

add(
    "sort_categories_by_revenue",
    "S01",
    lambda w: w.product_quality_matrix.select("product_category", "total_revenue"),
    query(
        """SELECT product_category, CAST(total_revenue AS DOUBLE) AS total_revenue
        FROM matrix ORDER BY total_revenue DESC, product_category"""
    ),
)
add(
    "sort_top_categories",
    "S03",
    lambda w: w.product_quality_matrix.select("product_category", "total_revenue")
    .orderBy(F.col("total_revenue").desc(), "product_category")
    .limit(10),
    query(
        """SELECT product_category, CAST(total_revenue AS DOUBLE) AS total_revenue
        FROM matrix ORDER BY total_revenue DESC, product_category LIMIT 10"""
    ),
)
add(
    "subquery_scalar_time_bands",
    "Q03 R16 X07",
    lambda w: products.category_metrics(w.fct_plain, w.dim_products, w.dim_orders).agg(
        F.sum("recent_rev").cast(MONEY).alias("recent_rev"),
        F.sum("prev_rev").cast(MONEY).alias("prev_rev"),
    ),
    query(
        """SELECT CAST(sum(recent_rev) AS DOUBLE) AS recent_rev,
               CAST(sum(prev_rev) AS DOUBLE) AS prev_rev FROM category_sums"""
    ),
)
add(
    "subquery_named_steps",
    "Q01 Q02",
    lambda w: (
        w.fct_plain.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("items"))
        .groupBy("items")
        .agg(F.count(F.lit(1)).alias("orders"))
    ),
    query(
        """SELECT items, count(*) AS orders
        FROM (SELECT order_id, count(*) AS items FROM fct_plain GROUP BY ALL) GROUP BY ALL"""
    ),
)
