"""Raw tables, staging tables and marts."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import functions as F

from mercato.catalog.oracle import percent, quadrant, query, table
from mercato.catalog.registry import RetailWarehouse as W
from mercato.catalog.registry import add
from mercato.functions.rules import Cutoffs
from mercato.operators.durable import new_path
from mercato.plans import growth, staging
from mercato.plans.warehouse import Warehouse
from mercato.sources.retail import RANGE_END, RANGE_START
from mercato.sources.schemas import RAW_SCHEMAS
from mercato.sources.tables import export_csv, publish, read_raw, read_table

ORDER_MOMENTS = (
    "order_purchase_timestamp order_approved_at order_delivered_carrier_date"
    " order_delivered_customer_date order_estimated_delivery_date"
)


def _reopened(w: W, **options) -> Warehouse:
    """A warehouse over the same raw tables with other options."""
    return Warehouse.from_raw(w.raw, start=RANGE_START, end=RANGE_END, **options)


# Raw tables

_RAW_ORACLE = {
    "orders": table("raw_orders", moments=ORDER_MOMENTS),
    "items": table("raw_items", doubles="price freight_value"),
    "payments": table("raw_payments", doubles="payment_value"),
}


def _raw(name: str, w: W):
    return w.raw[name]


for _name in RAW_SCHEMAS:
    add(f"raw_{_name}", "IO01", partial(_raw, _name), _RAW_ORACLE.get(_name) or table(f"raw_{_name}"))

# Staging

add(
    "dim_customers",
    "P01 J01 A01 R01 R02 R03 F05 Q01",
    lambda w: w.dim_customers,
    table("dim_customers", moments="first_order recent_order"),
)
add(
    "dim_orders",
    "P02 J02 J03 J04 A02 A03 A04",
    lambda w: w.dim_orders,
    table("dim_orders", moments=ORDER_MOMENTS, doubles="total_order_payment_value"),
)
add("dim_products", "P03 J05 R04 R05", lambda w: w.dim_products, table("dim_products"))
add("dim_sellers", "P04 A05 R01 R02 F05", lambda w: w.dim_sellers, table("dim_sellers"))
add(
    "fct_sales",
    "P05 J06 J07 R06 W01 F08",
    lambda w: w.fct_sales,
    table("fct_sales", days="purchase_date", doubles="price freight_value item_total_value"),
)

# Marts

GROWTH_DOUBLES = (
    "current_month_sale current_month_freight current_month_revenue prev_month_revenue"
)
add(
    "monthly_growth",
    "P06 A06 W02 W03 R07 R08 X01 X02 X03",
    lambda w: w.monthly_growth,
    table("growth", days="sales_month", doubles=GROWTH_DOUBLES),
)
add(
    "monthly_growth_diff",
    "P07 A06 W02",
    lambda w: w.monthly_growth_diff,
    table(
        "month_steps",
        days="sales_month",
        doubles=GROWTH_DOUBLES + " mom_revenue_diff",
        drop="rolling, overall",
    ),
)
add(
    "daily_volatility",
    "P08 A07 W04 W05",
    lambda w: w.daily_volatility,
    table(
        "volatility",
        days="sales_date",
        doubles="current_day_sale current_day_freight current_day_revenue",
    ),
)
add(
    "customer_journey",
    "P09 J11 J12 J13 J14 A10 A11 W07 R10 R11",
    lambda w: w.customer_journey,
    table(
        "journey",
        days="first_order_date second_order_date recent_order_date",
        doubles="total_lifetime_revenue",
        drop="is_returned_30d, is_returned_365d",
    ),
)
add(
    "winback_segmentation",
    "P10 IO04 W08 F03 R12 S01",
    lambda w: w.winback_segmentation,
    table("winback", days="first_order_date recent_order_date", doubles="potential_recovery_value"),
)
add(
    "product_quality_matrix",
    "P11 J15 J16 A12 A13 A14 W09 W10 R13 R14 R15 R16 R24 S01 Q03",
    lambda w: w.product_quality_matrix,
    table("matrix", doubles="total_revenue"),
)
add(
    "unit_economics",
    "P12 J17 W11 R17 R18 R19",
    lambda w: w.unit_economics,
    table("economics", doubles="price freight_value total_order_payment_value"),
)
add(
    "strategic_risk_map",
    "P13 J18 A15 W12 R20 R21 R22 R23 X12",
    lambda w: w.strategic_risk_map,
    table("risk_map", doubles="seller_category_revenue"),
)
add(
    "executive_summary",
    "P14 IO04 J08 J09 J10 A08 A09 W06 R09",
    lambda w: w.executive_summary,
    table(
        "executive",
        days="sales_month",
        doubles="current_month_revenue canceled_revenue_loss",
        drop="canceled_price_loss",
    ),
)

# Variants


def _seasonality(w: W, baseline: str):
    months = growth.month_totals(w.fct_plain, w.start, w.end)
    return growth.seasonality(
        months.select("sales_month", "current_month_revenue"), baseline
    ).drop("cycle_event")


add(
    "global_seasonality",
    "P15",
    lambda w: _seasonality(w, "global"),
    query(
        f"""SELECT CAST(sales_month AS VARCHAR) AS sales_month,
               CAST(current_month_revenue AS DOUBLE) AS current_month_revenue,
               {percent("current_month_revenue", "overall")} AS seasonality_index,
               CASE WHEN current_month_revenue / overall > 1.2 THEN 'Seasonal Peak'
                    WHEN current_month_revenue / overall < 0.8 THEN 'Slow Period'
                    ELSE 'Organic/Stable' END AS growth_classification
        FROM month_steps"""
    ),
)


def _journey_with_window(w: W, days: int):
    return w.journey(Cutoffs(return_days=days)).select(
        "customer_unique_id", F.col("is_returned_90d").alias(f"is_returned_{days}d")
    )


for _days in (30, 365):
    add(
        f"customer_journey_return_{_days}d",
        "O05 R10",
        partial(_journey_with_window, days=_days),
        query(f"SELECT customer_unique_id, is_returned_{_days}d FROM journey"),
    )

# Category means lie close together in the retail tables; these cut-offs reach
# all four quadrants.
_CLOSE_CUTOFFS = Cutoffs(loved_score=Decimal("3.4"), disliked_score=Decimal("3.3"))
add(
    "product_quality_matrix_close_cutoffs",
    "P11 R14",
    lambda w: w.quality_matrix(cut=_CLOSE_CUTOFFS).select(
        "product_category", "matrix_position"
    ),
    query(
        f"""SELECT product_category,
               {quadrant("total_revenue", "mean_revenue", "mean_score", "3.4", "3.3")}
                   AS matrix_position
        FROM category_shares"""
    ),
)
add(
    "product_quality_matrix_review_guard",
    "O03 R24",
    lambda w: _reopened(w, minimum_reviews=900).product_quality_matrix.select(
        "product_category", "toxicity_ratio_pct"
    ),
    query(
        f"""SELECT product_category,
               CASE WHEN total_reviews >= 900
                    THEN {percent("one_star_count", "total_reviews")} END AS toxicity_ratio_pct
        FROM category_shares"""
    ),
)
add(
    "fct_sales_hash_key",
    "O01",
    lambda w: _reopened(
        w, key="hash", hash_columns=("order_id", "order_item_id", "product_id", "seller_id")
    ).fct_sales.select("sales_key", "order_id", "item_sequence_number", "item_total_value"),
    query(
        f"""SELECT sha256(concat({", ".join(
            f"coalesce(concat(length(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '~')"
            for c in ("order_id", "item_sequence_number", "product_id", "seller_id")
        )})) AS sales_key,
               order_id, item_sequence_number, CAST(item_total_value AS DOUBLE) AS item_total_value
        FROM fct_plain"""
    ),
)
add(
    "dim_customers_latest_location",
    "O02",
    lambda w: staging.dim_customers(w.raw["customers"], w.raw["orders"], "latest").select(
        "customer_unique_id", "customer_city", "customer_state", "brazil_region"
    ),
    query(
        """SELECT customer_unique_id, customer_city, coalesce(state, 'Unknown') AS customer_state,
               coalesce(region, 'Unknown') AS brazil_region
        FROM (SELECT customer_unique_id, customer_city, customer_state AS code
              FROM raw_customers LEFT JOIN raw_orders USING (customer_id)
              QUALIFY row_number() OVER (PARTITION BY customer_unique_id
                  ORDER BY order_purchase_timestamp DESC NULLS LAST, customer_id DESC) = 1)
        LEFT JOIN geography USING (code)"""
    ),
)
add(
    "executive_summary_product_leakage",
    "O04",
    lambda w: _reopened(w, lost_measure="price").executive_summary.select(
        "sales_month", "canceled_revenue_loss"
    ),
    query(
        """SELECT CAST(sales_month AS VARCHAR) AS sales_month,
               CAST(canceled_price_loss AS DOUBLE) AS canceled_revenue_loss FROM executive"""
    ),
)

# Sources and sinks


def _staged(w: W) -> Warehouse:
    """A warehouse over staging tables written anew."""
    folder = new_path(w.spark, "staged")
    w.stage(folder)
    return Warehouse.from_staged(w.spark, folder, start=RANGE_START, end=RANGE_END)


def _staged_row_counts(w: W):
    staged = _staged(w)
    counts = [
        getattr(staged, name)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name in ("dim_customers", "dim_orders", "dim_products", "dim_sellers", "fct_sales")
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


add(
    "staged_row_counts",
    "IO02",
    _staged_row_counts,
    query(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {part}"
            for name, part in [
                ("dim_customers", "dim_customers"),
                ("dim_orders", "dim_orders"),
                ("dim_products", "dim_products"),
                ("dim_sellers", "dim_sellers"),
                ("fct_sales", "fct_plain"),
            ]
        )
    ),
)
add(
    "staged_monthly_growth",
    "IO02 P06 F01 A06",
    lambda w: _staged(w).monthly_growth,
    table("growth", days="sales_month", doubles=GROWTH_DOUBLES),
)
add(
    "staged_monthly_growth_diff",
    "IO02 P07 A06 W02",
    lambda w: _staged(w).monthly_growth_diff,
    table(
        "month_steps",
        days="sales_month",
        doubles=GROWTH_DOUBLES + " mom_revenue_diff",
        drop="rolling, overall",
    ),
)
add(
    "staged_daily_volatility",
    "IO02 P08 A07 W04 W05",
    lambda w: _staged(w).daily_volatility,
    table(
        "volatility",
        days="sales_date",
        doubles="current_day_sale current_day_freight current_day_revenue",
    ),
)


def _quarters(w: W):
    """Quarters out of the daily sales, without the fact; an order of several days counts once."""
    days = _staged(w).daily_sales.where("purchase_date IS NOT NULL")
    quarters = days.withColumn("sales_quarter", F.trunc("purchase_date", "quarter"))
    return growth.revenue_totals(quarters, "sales_quarter", "quarter")


add(
    "quarters_of_daily_sales",
    "IO02 A06 A07",
    _quarters,
    query(
        """SELECT CAST(CAST(date_trunc('quarter', purchase_date) AS DATE) AS VARCHAR) AS sales_quarter,
                  CAST(sum(price) AS DOUBLE) AS quarter_sale,
                  CAST(sum(freight_value) AS DOUBLE) AS quarter_freight,
                  CAST(sum(item_total_value) AS DOUBLE) AS quarter_revenue,
                  count(DISTINCT order_id) AS total_orders, CAST(sum(is_late) AS BIGINT) AS late_deliveries
           FROM fct_plain WHERE purchase_date IS NOT NULL GROUP BY ALL"""
    ),
)


def _view_query(w: W):
    publish({"executive_summary": w.executive_summary}, prefix="core_")
    return w.spark.sql(
        "SELECT business_health_status, count(*) AS months, max(mom_growth_pct) AS best_growth"
        " FROM core_executive_summary GROUP BY business_health_status"
    )


add(
    "view_executive_summary",
    "IO03",
    _view_query,
    query(
        """SELECT business_health_status, count(*) AS months, max(mom_growth_pct) AS best_growth
        FROM executive GROUP BY ALL"""
    ),
)


def _csv_round_trip(w: W):
    path = new_path(w.spark, "export")
    export_csv(w.product_quality_matrix, path)
    return read_table(w.spark, path, w.product_quality_matrix.schema)


def _csv_raw_tables(w: W):
    """The raw tables written as CSV folders, read back by header, and a mart over them."""
    paths = {}
    for name in RAW_SCHEMAS:
        paths[name] = new_path(w.spark, f"raw-{name}")
        export_csv(w.raw[name], paths[name])
    raw = read_raw(w.spark, paths)
    return Warehouse.from_raw(raw, start=RANGE_START, end=RANGE_END).monthly_growth


add(
    "csv_raw_tables",
    "IO01 P06",
    _csv_raw_tables,
    table("growth", days="sales_month", doubles=GROWTH_DOUBLES),
)


def _csv_quarantine(w: W):
    """Item files in two column orders, some prices unreadable: what is kept and what is set aside."""
    path, bad = new_path(w.spark, "mixed-items"), new_path(w.spark, "bad-items")
    items = w.raw["items"]
    cents = (F.col("price") * 100).cast("long")
    texts = items.select(
        *(F.col(name) for name in items.columns if name != "price"),
        F.when(cents % 97 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string")).alias("price"),
    )
    even = F.col("order_item_id") % 2 == 0
    export_csv(texts.where(even), f"{path}/even")
    export_csv(texts.where(~even).select(*reversed(texts.columns)), f"{path}/odd")
    kept = read_table(w.spark, path, RAW_SCHEMAS["items"], quarantine=bad)
    whole = kept.agg(
        F.lit("kept").alias("records"),
        F.count(F.lit(1)).alias("n"),
        F.sum("price").cast("double").alias("price"),
        F.sum("order_item_id").alias("item_numbers"),
    )
    aside = w.spark.read.parquet(bad).groupBy(F.element_at(F.split("reason", ": "), 1).alias("records"))
    return whole.unionByName(aside.agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


add(
    "csv_quarantine",
    "IO01 IO05",
    _csv_quarantine,
    query(
        """SELECT 'kept' AS records, count(*) AS n, CAST(sum(price) AS DOUBLE) AS price,
               CAST(sum(order_item_id) AS BIGINT) AS item_numbers
        FROM raw_items WHERE CAST(price * 100 AS BIGINT) % 97 <> 0
        UNION ALL
        SELECT 'price is no decimal(12,2)', count(*), NULL, NULL
        FROM raw_items WHERE CAST(price * 100 AS BIGINT) % 97 = 0 HAVING count(*) > 0"""
    ),
)
add("csv_export", "IO05 IO01", _csv_round_trip, table("matrix", doubles="total_revenue"))
