"""DuckDB SQL for the raw tables, the star and the marts.

The SQL is written apart from the DataFrame code and serves only to check it.
``query`` puts the named parts a statement uses in front of it.
"""

from __future__ import annotations

import re

from mercato.functions.geography import REGIONS
from mercato.sources.retail import PAYMENT_TYPES, RANGE_END, RANGE_START, SCORES, STATES


def rounded(value: str, digits: int = 2) -> str:
    """Half away from zero; the detour over DECIMAL avoids binary ties."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def percent(part: str, whole: str) -> str:
    return rounded(f"100.0 * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)")


def half_up(part: str, whole: str, digits: int = 2) -> str:
    """``part / whole`` rounded in whole numbers; both are counts of cents or rows."""
    unit = 10**digits
    return (
        f"CAST((2 * CAST({part} AS HUGEINT) * {unit} + {whole}) // (2 * CAST({whole} AS HUGEINT))"
        f" AS DOUBLE) / {unit}"
    )


def cents(amount: str) -> str:
    return f"CAST(CAST({amount} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_GEOGRAPHY = ", ".join(
    f"('{code}', '{name}', '{region}')"
    for region, states in REGIONS.items()
    for code, name in states.items()
)
_IN_RANGE = f">= DATE '{RANGE_START}' AND {{0}} < DATE '{RANGE_END}'"


def in_range(column: str) -> str:
    return f"{column} " + _IN_RANGE.format(column)


def size_bucket(volume: str) -> str:
    return (
        f"CASE WHEN {volume} < 5000 THEN 'Small' WHEN {volume} BETWEEN 5000 AND 20000 THEN 'Medium'"
        f" WHEN {volume} BETWEEN 20001 AND 50000 THEN 'Large'"
        f" WHEN {volume} > 50000 THEN 'Extra Large' ELSE 'Unknown' END"
    )


def health(growth: str, score: str, before: str) -> str:
    return (
        f"CASE WHEN {growth} < 0 THEN 'Contraction'"
        f" WHEN {growth} > 0 AND {score} >= {before} THEN 'Efficient Scaling'"
        f" WHEN {growth} > 0 AND {score} < 0.98 * {before} THEN 'Toxic Growth'"
        " ELSE 'Stable' END"
    )


def growth_class(revenue: str, usual: str) -> str:
    return (
        f"CASE WHEN {usual} IS NULL THEN 'Initializing'"
        f" WHEN {usual} <> 0 AND {revenue} / {usual} > 1.2 THEN 'Seasonal Peak'"
        f" WHEN {usual} <> 0 AND {revenue} / {usual} < 0.8 THEN 'Slow Period'"
        " ELSE 'Organic/Stable' END"
    )


def event(day: str) -> str:
    return (
        f"coalesce(map {{3: 'Consumer Day', 11: 'Black Friday', 12: 'Holiday Season'}}"
        f"[month({day})], 'Regular')"
    )


def quadrant(revenue: str, mean: str, score: str, high: str = "4.0", low: str = "3.5") -> str:
    return (
        f"CASE WHEN {score} >= {high} THEN if({revenue} > {mean}, 'Core Strengths', 'Niche Winners')"
        f" WHEN {score} < {low} AND {revenue} > {mean} THEN 'Revenue Traps'"
        " ELSE 'Underperformers' END"
    )


def lifecycle(recent: str, previous: str) -> str:
    change = f"CAST({recent} - {previous} AS DOUBLE) / {previous}"
    return (
        f"CASE WHEN {previous} = 0 THEN 'New' WHEN {change} > 0.2 THEN 'Emerging'"
        f" WHEN {change} < -0.1 THEN 'Declining' ELSE 'Stable' END"
    )


def efficiency(index: str) -> str:
    return (
        f"CASE WHEN {index} < 0.9 THEN 'Efficient Transaction'"
        f" WHEN {index} > 1.5 THEN 'Critical Outlier (>1.5x Avg)'"
        f" WHEN {index} > 1.1 THEN 'Expensive Transaction' ELSE 'Regional Baseline' END"
    )


def freight_bucket(ratio: str) -> str:
    return (
        f"CASE WHEN {ratio} > 0.5 OR {ratio} IS NULL THEN '50%+ (Critical)'"
        f" WHEN {ratio} > 0.2 THEN '20-50% (High)' WHEN {ratio} > 0.1 THEN '10-20% (Mid)'"
        " ELSE '0-10% (Low)' END"
    )


def installments(count: str) -> str:
    return (
        f"CASE WHEN {count} > 10 OR {count} IS NULL THEN 'Long-term (10+)'"
        f" WHEN {count} > 5 THEN 'Mid-term (6-10)' WHEN {count} > 1 THEN 'Short-term (2-5)'"
        " ELSE 'Single Pay' END"
    )


def lane_risk(late: str, items: str, score: str) -> str:
    return (
        f"CASE WHEN {late} * 20 <= {items} * 3 THEN 'Stable Lane'"
        f" WHEN {late} * 5 > {items} AND {score} < 3.5 THEN 'Critical Risk Lane'"
        " ELSE 'Logistical Bottleneck' END"
    )


# Parts in order of dependence.
PARTS: dict[str, str] = {
    "geography": f"SELECT * FROM (VALUES {_GEOGRAPHY}) AS g(code, state, region)",
    "shifted": """
        SELECT *, CASE WHEN month(o_orderdate) = 10 AND o_orderkey % 5 < 3 THEN 31
                       WHEN month(o_orderdate) = 2 AND o_orderkey % 5 < 2 THEN 28
                       ELSE 0 END AS shift
        FROM orders""",
    "placed_orders": """
        SELECT o_orderkey AS k, o_orderdate AS day, shift,
               o_orderdate + to_days(CAST(shift AS INTEGER)) + to_seconds(o_orderkey % 86400) AS placed,
               CASE o_orderkey % 50 WHEN 7 THEN 'canceled' WHEN 8 THEN 'shipped'
                    ELSE 'delivered' END AS fate
        FROM shifted""",
    "raw_orders": """
        SELECT k AS order_id, k AS customer_id, fate AS order_status,
               placed AS order_purchase_timestamp,
               placed + INTERVAL 1 HOUR AS order_approved_at,
               CASE WHEN fate <> 'canceled' THEN placed + INTERVAL 1 DAY END
                   AS order_delivered_carrier_date,
               CASE WHEN fate = 'delivered' AND k % 1000 <> 1
                    THEN placed + to_days(CAST(3 + (k * 7) % 23 AS INTEGER)) END
                   AS order_delivered_customer_date,
               day + to_days(CAST(shift + 20 AS INTEGER)) AS order_estimated_delivery_date
        FROM placed_orders""",
    "raw_customers": f"""
        SELECT o_orderkey AS customer_id,
               if(o_orderkey % 10 = 0, 'C' || o_custkey, 'O' || o_orderkey) AS customer_unique_id,
               'city_' || (o_orderkey % 7) AS customer_city,
               {_list(STATES)}[1 + o_custkey % {len(STATES)}] AS customer_state
        FROM orders""",
    "raw_payments": f"""
        SELECT o_orderkey AS order_id, {_list(PAYMENT_TYPES)}[1 + o_orderkey % 4] AS payment_type,
               CAST(1 + o_orderkey % 13 AS INTEGER) AS payment_installments,
               CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 0.01 AS DECIMAL(12,2)) AS payment_value
        FROM orders WHERE o_orderkey % 500 <> 9
        UNION ALL
        SELECT o_orderkey, 'voucher', 1, 10.00 FROM orders WHERE o_orderkey % 5 = 0""",
    "raw_reviews": f"""
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 20 <> 4
                    THEN {_list(SCORES)}[1 + (o_orderkey * 31) % {len(SCORES)}] END AS review_score
        FROM orders WHERE o_orderkey % 20 <> 3
        UNION ALL
        SELECT o_orderkey, CAST(1 + ((o_orderkey * 3) % 7) % 5 AS INTEGER)
        FROM orders WHERE o_orderkey % 25 = 5""",
    "raw_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 50 <> 1 THEN p_name END
                   AS product_category_name,
               p_size * 100 AS product_weight_g,
               CASE WHEN p_partkey % 97 <> 0 THEN p_size + 10 END AS product_length_cm,
               CAST(5 + p_partkey % 40 AS INTEGER) AS product_width_cm,
               CAST(5 + p_partkey % 30 AS INTEGER) AS product_height_cm
        FROM part""",
    "raw_translation": """
        SELECT DISTINCT p_name AS product_category_name,
               if(p_name LIKE 'red %', '', 'en_' || replace(p_name, ' ', '_'))
                   AS product_category_name_english
        FROM part WHERE p_name NOT LIKE 'blue %'""",
    "raw_sellers": f"""
        SELECT s_suppkey AS seller_id, 'city_' || (s_suppkey % 9) AS seller_city,
               {_list(STATES)}[1 + s_nationkey] AS seller_state
        FROM supplier""",
    "raw_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id,
               CAST(if(l_partkey % 997 = 0, 0, cents) * 0.01 AS DECIMAL(12,2)) AS price,
               CAST((cents * (CAST(round(l_tax * 100) AS BIGINT) * 8 + 2) // 100) * 0.01
                    AS DECIMAL(12,2)) AS freight_value
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
    "dim_customers": """
        SELECT customer_unique_id, city AS customer_city,
               coalesce(state, 'Unknown') AS customer_state,
               coalesce(region, 'Unknown') AS brazil_region,
               first_order, recent_order,
               CAST(datesub('day', first_order, recent_order) AS INTEGER) AS customer_lifespan_days,
               CAST(coalesce(recent_order > first_order, false) AS INTEGER) AS is_repeat_buyer
        FROM (SELECT customer_unique_id, max(customer_city) AS city, max(customer_state) AS code,
                     min(order_purchase_timestamp) AS first_order,
                     max(order_purchase_timestamp) AS recent_order
              FROM raw_customers LEFT JOIN raw_orders USING (customer_id)
              GROUP BY ALL)
        LEFT JOIN geography USING (code)""",
    "payment_sums": """
        SELECT order_id, sum(payment_value) AS total_order_payment_value,
               max(payment_type) AS primary_payment_type,
               max(payment_installments) AS max_installments
        FROM raw_payments GROUP BY ALL""",
    "score_means": f"""
        SELECT order_id, coalesce({rounded("sum(review_score) / count(review_score)")}, -1)
                   AS review_score
        FROM raw_reviews GROUP BY ALL""",
    "baskets": """
        SELECT order_id, count(order_item_id) AS basket_size FROM raw_items GROUP BY ALL""",
    "dim_orders": """
        SELECT o.*, total_order_payment_value, primary_payment_type, max_installments,
               review_score, coalesce(basket_size, 0) AS basket_size
        FROM raw_orders o LEFT JOIN payment_sums USING (order_id)
        LEFT JOIN score_means USING (order_id) LEFT JOIN baskets USING (order_id)""",
    "dim_products": f"""
        SELECT product_id,
               if(product_category_name_english <> '', product_category_name_english,
                  product_category_name) AS product_category,
               product_weight_g, CAST(volume AS BIGINT) AS volume_cm3, {size_bucket("volume")} AS volume_category
        FROM (SELECT p.*, t.product_category_name_english,
                     product_length_cm * product_width_cm * product_height_cm AS volume
              FROM raw_products p LEFT JOIN raw_translation t
                   USING (product_category_name))""",
    "dim_sellers": """
        SELECT seller_id, city AS seller_city, coalesce(state, 'Unknown') AS seller_state,
               coalesce(region, 'Unknown') AS brazil_region
        FROM (SELECT seller_id, max(seller_city) AS city, max(seller_state) AS code
              FROM raw_sellers GROUP BY ALL)
        LEFT JOIN geography USING (code)""",
    "fct_plain": """
        SELECT i.order_id, order_item_id AS item_sequence_number, product_id, customer_unique_id,
               seller_id, price, freight_value, price + freight_value AS item_total_value,
               (epoch(order_delivered_customer_date) - epoch(order_purchase_timestamp)) / 86400.0
                   AS days_to_delivery,
               CAST(coalesce(order_delivered_customer_date > order_estimated_delivery_date, false)
                    AS INTEGER) AS is_late,
               CAST(coalesce(order_status = 'delivered', false) AS INTEGER) AS is_delivered,
               CAST(order_purchase_timestamp AS DATE) AS purchase_date
        FROM raw_items i
        LEFT JOIN (raw_orders LEFT JOIN raw_customers USING (customer_id)) b USING (order_id)""",
    "fct_sales": """
        SELECT row_number() OVER (ORDER BY order_id, item_sequence_number, product_id, seller_id,
                                           price, freight_value) AS sales_key, *
        FROM fct_plain""",
    "month_totals": f"""
        SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS sales_month,
               sum(price) AS current_month_sale, sum(freight_value) AS current_month_freight,
               sum(item_total_value) AS current_month_revenue,
               count(DISTINCT order_id) AS total_orders,
               CAST(sum(is_late) AS BIGINT) AS late_deliveries
        FROM fct_plain WHERE {in_range("purchase_date")} GROUP BY ALL""",
    "month_steps": f"""
        SELECT *, strftime(sales_month, '%b %Y') AS sales_month_display,
               lag(current_month_revenue) OVER w AS prev_month_revenue,
               {percent("current_month_revenue - lag(current_month_revenue) OVER w",
                        "lag(current_month_revenue) OVER w")} AS mom_growth_pct,
               current_month_revenue - lag(current_month_revenue) OVER w AS mom_revenue_diff,
               {percent("late_deliveries", "total_orders")} AS late_delivery_rate_pct,
               avg(current_month_revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling,
               avg(current_month_revenue) OVER () AS overall
        FROM month_totals WINDOW w AS (ORDER BY sales_month)""",
    "growth": f"""
        SELECT sales_month, sales_month_display, current_month_sale, current_month_freight,
               current_month_revenue, prev_month_revenue, mom_growth_pct,
               {percent("current_month_revenue", "rolling")} AS seasonality_index,
               total_orders, late_deliveries, late_delivery_rate_pct,
               {growth_class("current_month_revenue", "rolling")} AS growth_classification,
               {event("sales_month")} AS cycle_event
        FROM month_steps""",
    "day_totals": f"""
        SELECT purchase_date AS sales_date, sum(price) AS current_day_sale,
               sum(freight_value) AS current_day_freight,
               sum(item_total_value) AS current_day_revenue,
               count(DISTINCT order_id) AS total_orders
        FROM fct_plain WHERE {in_range("purchase_date")} GROUP BY ALL""",
    "volatility": f"""
        SELECT *, {half_up(f"sum({cents('current_day_revenue')}) OVER w",
                          "(100 * count(*) OVER w)")} AS revenue_average_30d,
               coalesce({rounded("stddev_samp(CAST(current_day_revenue AS DOUBLE)) OVER w")}, 0)
                   AS revenue_volatility_30d
        FROM day_totals WINDOW w AS (ORDER BY sales_date ROWS 29 PRECEDING)""",
    "sentiment": f"""
        SELECT *, lag(mean_score) OVER (ORDER BY sales_month) AS mean_score_before
        FROM (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS sales_month,
                     avg(review_score) FILTER (WHERE review_score <> -1) AS mean_score,
                     count(*) FILTER (WHERE order_status = 'delivered') AS delivered_count,
                     count(*) FILTER (WHERE order_status = 'canceled') AS canceled_count,
                     count(*) AS total_order_volume
              FROM dim_orders WHERE {in_range("order_purchase_timestamp")} GROUP BY ALL)""",
    "leakage": """
        SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS sales_month,
               sum(item_total_value) AS canceled_revenue_loss, sum(price) AS canceled_price_loss
        FROM fct_plain
        WHERE order_id IN (SELECT order_id FROM raw_orders WHERE order_status = 'canceled')
        GROUP BY ALL""",
    "executive": f"""
        SELECT sales_month, sales_month_display, current_month_revenue, mom_growth_pct,
               {rounded("mean_score")} AS avg_review_score,
               {percent("delivered_count", "total_order_volume")} AS fulfillment_ratio_pct,
               coalesce(canceled_revenue_loss, 0) AS canceled_revenue_loss,
               coalesce(canceled_price_loss, 0) AS canceled_price_loss,
               {health("mom_growth_pct", "mean_score", "mean_score_before")}
                   AS business_health_status,
               late_delivery_rate_pct AS logistics_pressure_index
        FROM growth LEFT JOIN sentiment USING (sales_month) LEFT JOIN leakage USING (sales_month)""",
    "buyer_stats": """
        SELECT customer_unique_id, count(DISTINCT order_id) AS total_lifetime_orders,
               sum(item_total_value) AS total_lifetime_revenue
        FROM fct_plain GROUP BY ALL""",
    "touches": """
        SELECT customer_unique_id, bought[1].o AS first_order_id, bought[2].d AS second_order_date
        FROM (SELECT customer_unique_id,
                     list({'d': purchase_date, 'o': order_id}
                          ORDER BY purchase_date, order_id, item_sequence_number) AS bought
              FROM fct_plain GROUP BY ALL)""",
    "journey": """
        SELECT customer_unique_id, customer_city, customer_state, first_day AS first_order_date,
               review_score AS first_order_review_score, second_order_date,
               CAST(coalesce(second_order_date - first_day BETWEEN 1 AND 90, false) AS INTEGER)
                   AS is_returned_90d,
               CAST(coalesce(second_order_date - first_day BETWEEN 1 AND 30, false) AS INTEGER)
                   AS is_returned_30d,
               CAST(coalesce(second_order_date - first_day BETWEEN 1 AND 365, false) AS INTEGER)
                   AS is_returned_365d,
               recent_day AS recent_order_date, total_lifetime_orders, total_lifetime_revenue,
               customer_lifespan_days + 1 AS customer_lifespan_days, is_repeat_buyer,
               CAST(last_day - recent_day AS INTEGER) AS recency_days,
               CAST(last_day - recent_day > 180 AS INTEGER) AS is_churned
        FROM (SELECT *, CAST(first_order AS DATE) AS first_day, CAST(recent_order AS DATE) AS recent_day,
                     (SELECT max(purchase_date) FROM fct_plain) AS last_day
              FROM dim_customers)
        JOIN buyer_stats USING (customer_unique_id)
        LEFT JOIN touches USING (customer_unique_id)
        LEFT JOIN score_means ON order_id = first_order_id""",
    "winback": """
        SELECT customer_unique_id, customer_city, customer_state, first_order_date,
               recent_order_date, recency_days, first_order_review_score,
               total_lifetime_revenue AS potential_recovery_value, total_lifetime_orders,
               if(is_repeat_buyer = 1, 'High Priority: Lapsed Loyal',
                  'Medium Priority: Lapsed One-Time') AS recovery_priority
        FROM journey
        WHERE is_churned = 1 AND first_order_review_score >= 4
          AND total_lifetime_revenue > (SELECT avg(total_lifetime_revenue) FROM journey)""",
    "last_day": "SELECT max(purchase_date) AS d FROM fct_plain",
    "category_lines": """
        SELECT product_category, order_id, item_total_value, purchase_date, review_score,
               (SELECT d FROM last_day) - purchase_date AS age
        FROM fct_plain JOIN dim_products USING (product_id) JOIN dim_orders USING (order_id)""",
    "category_sums": """
        SELECT product_category, sum(item_total_value) AS total_revenue,
               count(DISTINCT order_id) AS total_orders, avg(review_score) AS mean_score,
               count(*) FILTER (WHERE review_score = 1) AS one_star_count,
               count(review_score) AS total_reviews,
               coalesce(sum(item_total_value) FILTER (WHERE age <= 90), 0) AS recent_rev,
               coalesce(sum(item_total_value) FILTER (WHERE age BETWEEN 91 AND 180), 0) AS prev_rev
        FROM category_lines GROUP BY ALL""",
    "category_shares": """
        SELECT *, CAST(sum(total_revenue) OVER (ORDER BY total_revenue DESC) AS DOUBLE)
                      / sum(total_revenue) OVER () AS share,
               (SELECT avg(total_revenue) FROM category_sums) AS mean_revenue
        FROM category_sums WHERE product_category IS NOT NULL""",
    "matrix": f"""
        SELECT product_category, total_revenue, total_orders,
               if(share <= 0.8, 'Pareto Driver (Top 80%)', 'Long Tail') AS revenue_segment,
               {rounded("mean_score")} AS avg_review_score,
               {percent("one_star_count", "total_reviews")} AS toxicity_ratio_pct,
               {quadrant("total_revenue", "mean_revenue", "mean_score")} AS matrix_position,
               {lifecycle("recent_rev", "prev_rev")} AS lifecycle_status
        FROM category_shares""",
    "freight_lines": f"""
        SELECT f.sales_key, f.price, f.freight_value,
               CASE WHEN o.review_score <> -1 THEN o.review_score END AS review_score,
               o.max_installments, o.total_order_payment_value, s.seller_state, s.brazil_region,
               {cents("f.freight_value")} AS freight_cents, {cents("f.price")} AS price_cents,
               sum({cents("f.freight_value")}) OVER region AS region_cents,
               count(*) OVER region AS region_items
        FROM fct_sales f LEFT JOIN dim_orders o USING (order_id)
        LEFT JOIN dim_sellers s USING (seller_id)
        WINDOW region AS (PARTITION BY s.brazil_region)""",
    "freight_ratios": f"""
        SELECT *, {half_up("region_cents", "(100 * region_items)", 6)} AS regional_avg_freight,
               CASE WHEN price <> 0 THEN {half_up("freight_cents", "price_cents", 4)} END
                   AS freight_ratio,
               {half_up("freight_cents * region_items", "region_cents")}
                   AS regional_efficiency_index
        FROM freight_lines""",
    "economics": f"""
        SELECT * EXCLUDE (freight_cents, price_cents, region_cents, region_items),
               {efficiency("regional_efficiency_index")} AS transaction_efficiency_status,
               {freight_bucket("freight_ratio")} AS freight_ratio_bucket,
               {installments("max_installments")} AS installment_group
        FROM freight_ratios""",
    "lanes": """
        SELECT CASE WHEN product_category <> '' THEN product_category ELSE 'Uncategorized' END
                   AS product_category,
               seller_id, s.seller_state, s.brazil_region AS seller_region,
               c.customer_state, c.brazil_region AS customer_region,
               sum(item_total_value) AS seller_category_revenue,
               count(*) AS total_category_orders,
               avg(review_score) FILTER (WHERE review_score <> -1) AS mean_score,
               CAST(sum(is_late) AS BIGINT) AS total_late_orders
        FROM fct_plain JOIN dim_products USING (product_id) JOIN dim_sellers s USING (seller_id)
        JOIN dim_customers c USING (customer_unique_id) JOIN dim_orders USING (order_id)
        GROUP BY ALL""",
    "risk_map": f"""
        SELECT * EXCLUDE (mean_score), {rounded("mean_score", 6)} AS avg_lane_review,
               seller_state || ' -> ' || customer_state AS transit_lane,
               if(seller_region = customer_region, 'Intra-Region', 'Cross-Region') AS shipping_type,
               if(seller_revenue_rank <= 0.05, 'High Dependency Seller (Top 5%)',
                  'Long Tail Seller') AS dependency_segment,
               {percent("total_late_orders", "total_category_orders")} AS lane_late_rate_pct,
               {lane_risk("total_late_orders", "total_category_orders", "mean_score")}
                   AS strategic_risk_status
        FROM (SELECT *, percent_rank() OVER (PARTITION BY product_category
                                             ORDER BY seller_category_revenue DESC)
                            AS seller_revenue_rank
              FROM lanes)""",
}


def query(statement: str, **more: str) -> str:
    """``statement`` behind the parts it needs; ``more`` adds parts of its own."""
    parts = {**PARTS, **more}
    needed: set[str] = set()
    waiting = [statement]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        for name in parts.keys() & words - needed:
            needed.add(name)
            waiting.append(parts[name])
    if not needed:
        return statement
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items() if name in needed)
    return f"WITH {listed}\n{statement}"


def table(name: str, days: str = "", doubles: str = "", moments: str = "", drop: str = "") -> str:
    """All rows of a part with dates as text and decimals as doubles."""
    swaps = [f"CAST({c} AS VARCHAR) AS {c}" for c in (days + " " + moments).split()]
    swaps += [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles.split()]
    star = "*" + (f" EXCLUDE ({drop})" if drop else "")
    star += f" REPLACE ({', '.join(swaps)})" if swaps else ""
    return query(f"SELECT {star} FROM {name}")
