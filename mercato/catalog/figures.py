"""Dashboard figures."""

from __future__ import annotations

from mercato.catalog.oracle import percent, query, rounded
from mercato.catalog.registry import add
from mercato.plans import figures

EXECUTIVE = [
    (
        "figure_total_revenue", "K01", lambda w: figures.total_revenue(w.monthly_growth),
        "SELECT CAST(sum(current_month_revenue) AS DOUBLE) AS total_revenue FROM growth",
    ),
    (
        "figure_average_review", "K02", lambda w: figures.average_review(w.executive_summary),
        f"SELECT {rounded('avg(avg_review_score)')} AS avg_review_score FROM executive",
    ),
    (
        "figure_fulfillment_ratio", "K03", lambda w: figures.fulfillment_ratio(w.executive_summary),
        f"SELECT {rounded('avg(fulfillment_ratio_pct)')} AS fulfillment_ratio_pct FROM executive",
    ),
    (
        "figure_cancellation_leakage", "K04",
        lambda w: figures.cancellation_leakage(w.executive_summary),
        """SELECT CAST(sum(canceled_revenue_loss) AS DOUBLE) AS canceled_revenue_loss
        FROM executive""",
    ),
    (
        "figure_months_by_health", "K05", lambda w: figures.months_by_health(w.executive_summary),
        "SELECT business_health_status, count(*) AS months FROM executive GROUP BY ALL",
    ),
]

GROWTH = [
    (
        "figure_average_growth", "K06", lambda w: figures.average_growth(w.monthly_growth),
        f"SELECT {rounded('avg(mom_growth_pct)')} AS avg_mom_growth_pct FROM growth",
    ),
    (
        "figure_late_rate", "K07", lambda w: figures.late_rate(w.monthly_growth),
        f"""SELECT {rounded("avg(late_delivery_rate_pct)")} AS mean_monthly_late_pct,
               {percent("sum(late_deliveries)", "sum(total_orders)")} AS overall_late_pct,
               count(*) FILTER (WHERE late_delivery_rate_pct > 5) AS months_above_target
        FROM growth""",
    ),
    (
        "figure_largest_day", "K08 S03", lambda w: figures.largest_day(w.daily_volatility),
        """SELECT CAST(arg_max(sales_date, current_day_revenue) AS VARCHAR) AS sales_date,
               CAST(max(current_day_revenue) AS DOUBLE) AS current_day_revenue FROM day_totals""",
    ),
    (
        "figure_volatility_correlation", "K08",
        lambda w: figures.volatility_correlation(w.daily_volatility),
        f"""SELECT {rounded("corr(revenue_average_30d, revenue_volatility_30d)", 6)}
                   AS volatility_correlation FROM volatility""",
    ),
]

CUSTOMERS = [
    (
        "figure_repeat_rate", "K09", lambda w: figures.repeat_rate(w.customer_journey),
        f"""SELECT {percent("sum(is_repeat_buyer)", "count(*)")} AS repeat_customer_pct,
               {percent("sum(1 - is_repeat_buyer)", "count(*)")} AS one_time_pct FROM journey""",
    ),
    (
        "figure_repeat_revenue_share", "K10",
        lambda w: figures.repeat_revenue_share(w.customer_journey),
        f"""SELECT {percent("sum(total_lifetime_revenue) FILTER (WHERE is_repeat_buyer = 1)",
                            "sum(total_lifetime_revenue)")} AS repeat_revenue_pct FROM journey""",
    ),
    (
        "figure_repeat_lifespan", "K11", lambda w: figures.repeat_lifespan(w.customer_journey),
        f"""SELECT {rounded("avg(customer_lifespan_days)")} AS avg_lifespan_days
        FROM journey WHERE is_repeat_buyer = 1""",
    ),
    (
        "figure_return_rate", "K12", lambda w: figures.return_rate(w.customer_journey),
        f'SELECT {percent("sum(is_returned_90d)", "count(*)")} AS return_rate_pct FROM journey',
    ),
    (
        "figure_return_rate_by_score", "K13",
        lambda w: figures.return_rate_by_score(w.customer_journey),
        f"""SELECT first_order_review_score, count(*) AS customers,
               {percent("sum(is_returned_90d)", "count(*)")} AS return_rate_pct
        FROM journey GROUP BY ALL""",
    ),
]

PRODUCTS = [
    (
        "figure_top_revenue_category", "K14 S03",
        lambda w: figures.top_revenue_category(w.product_quality_matrix),
        """SELECT product_category, CAST(total_revenue AS DOUBLE) AS total_revenue
        FROM matrix ORDER BY total_revenue DESC, product_category LIMIT 1""",
    ),
    (
        "figure_best_loved_category", "K15 S03",
        lambda w: figures.best_loved_category(w.product_quality_matrix),
        """SELECT product_category, avg_review_score
        FROM matrix ORDER BY avg_review_score DESC NULLS LAST, product_category LIMIT 1""",
    ),
    (
        "figure_most_toxic_category", "K16 S03",
        lambda w: figures.most_toxic_category(w.product_quality_matrix),
        """SELECT product_category, toxicity_ratio_pct
        FROM matrix ORDER BY toxicity_ratio_pct DESC NULLS LAST, product_category LIMIT 1""",
    ),
    (
        "figure_quadrant_summary", "K17",
        lambda w: figures.quadrant_summary(w.product_quality_matrix),
        """SELECT matrix_position, count(*) AS categories,
               CAST(sum(total_revenue) AS DOUBLE) AS total_revenue FROM matrix GROUP BY ALL""",
    ),
]

LOGISTICS = [
    (
        "figure_freight_share", "K18", lambda w: figures.freight_share(w.unit_economics),
        f"SELECT {rounded('avg(freight_ratio) * 100')} AS avg_freight_ratio_pct FROM economics",
    ),
    (
        "figure_mean_efficiency", "K19", lambda w: figures.mean_efficiency(w.unit_economics),
        f"SELECT {rounded('avg(regional_efficiency_index)')} AS avg_efficiency_index FROM economics",
    ),
    (
        "figure_mean_transaction", "K20", lambda w: figures.mean_transaction(w.unit_economics),
        f"SELECT {rounded('avg(total_order_payment_value)')} AS avg_transaction_value FROM economics",
    ),
    (
        "figure_basket_by_installments", "K21",
        lambda w: figures.basket_by_installments(w.unit_economics),
        f"""SELECT installment_group, count(*) AS items,
               {rounded("avg(total_order_payment_value)")} AS avg_transaction_value
        FROM economics GROUP BY ALL""",
    ),
    (
        "figure_score_by_freight", "K22", lambda w: figures.score_by_freight(w.unit_economics),
        f"""SELECT freight_ratio_bucket, count(*) AS items,
               {rounded("avg(review_score)")} AS avg_review_score
        FROM economics GROUP BY ALL""",
    ),
    (
        "figure_freight_by_state", "K23 S03", lambda w: figures.freight_by_state(w.unit_economics),
        f"""SELECT seller_state, {rounded("avg(freight_value)")} AS avg_freight,
               CAST(sum(freight_value) AS DOUBLE) AS total_freight
        FROM economics GROUP BY ALL ORDER BY avg_freight DESC, seller_state LIMIT 3""",
    ),
]

RISK = [
    (
        "figure_critical_lanes", "K24", lambda w: figures.critical_lanes(w.strategic_risk_map),
        """SELECT count(*) AS critical_lanes
        FROM risk_map WHERE strategic_risk_status = 'Critical Risk Lane'""",
    ),
    (
        "figure_top_seller_share", "K25", lambda w: figures.top_seller_share(w.strategic_risk_map),
        f"""SELECT {percent("sum(seller_category_revenue) FILTER (WHERE seller_revenue_rank <= 0.05)",
                            "sum(seller_category_revenue)")} AS top_seller_revenue_pct
        FROM risk_map""",
    ),
    (
        "figure_top_sellers_by_state", "K26",
        lambda w: figures.top_sellers_by_state(w.strategic_risk_map),
        f"""SELECT seller_state, count(DISTINCT seller_id) AS sellers,
               {percent("count(DISTINCT seller_id)", "sum(count(DISTINCT seller_id)) OVER ()")}
                   AS seller_pct
        FROM risk_map WHERE seller_revenue_rank <= 0.05 GROUP BY seller_state""",
    ),
    (
        "figure_late_rate_by_lane", "K27 S03",
        lambda w: figures.late_rate_by_lane(w.strategic_risk_map),
        f"""SELECT transit_lane, {rounded("avg(lane_late_rate_pct)")} AS avg_late_rate_pct
        FROM risk_map GROUP BY ALL ORDER BY avg_late_rate_pct DESC, transit_lane LIMIT 10""",
    ),
    (
        "figure_late_rate_by_shipping", "K28",
        lambda w: figures.late_rate_by_shipping(w.strategic_risk_map),
        f"""SELECT shipping_type, {rounded("avg(lane_late_rate_pct)")} AS avg_late_rate_pct
        FROM risk_map GROUP BY ALL""",
    ),
    (
        "figure_platform_late_rate", "K29",
        lambda w: figures.platform_late_rate(w.strategic_risk_map),
        f"""SELECT {rounded("avg(lane_late_rate_pct)")} AS mean_lane_late_pct,
               {percent("sum(total_late_orders)", "sum(total_category_orders)")} AS overall_late_pct
        FROM risk_map""",
    ),
]

for _name, _covers, _build, _oracle in [
    *EXECUTIVE, *GROWTH, *CUSTOMERS, *PRODUCTS, *LOGISTICS, *RISK
]:
    add(_name, _covers, _build, query(_oracle))
