"""NULLs, ties, missing partners and other corner cases, by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

import market
from mercato.operators.joins import name_numbers, names_of_numbers, numbered_names
from mercato.plans import customers, executive, growth, logistics, products, risk, staging
from mercato.plans.warehouse import Warehouse


@pytest.fixture(scope="module")
def warehouse(spark):
    return Warehouse.from_raw(
        market.raw(spark), start=dt.date(2018, 1, 1), end=dt.date(2018, 4, 1)
    )


def by(frame, *keys):
    key = (lambda r: r[keys[0]]) if len(keys) == 1 else (lambda r: tuple(r[k] for k in keys))
    return {key(row): row for row in frame.collect()}


def test_customer_places_span_and_repeat_flag(warehouse):
    people = by(warehouse.dim_customers, "customer_unique_id")
    # City and state are picked apart: the last of each by name.
    assert (people["u1"].customer_city, people["u1"].customer_state) == ("santos", "Unknown")
    assert people["u1"].customer_lifespan_days == 0
    assert people["u1"].is_repeat_buyer == 1
    assert people["u3"].brazil_region == "Unknown"
    assert people["u2"].customer_state == "Rio Grande do Norte"
    assert (people["u2"].is_repeat_buyer, people["u2"].brazil_region) == (0, "Northeast")


def test_customer_latest_location(spark):
    raw = market.raw(spark)
    people = by(staging.dim_customers(raw["customers"], raw["orders"], "latest"), "customer_unique_id")
    assert people["u1"].customer_city == "campinas"
    with pytest.raises(ValueError):
        staging.dim_customers(raw["customers"], raw["orders"], "first")


def test_order_scores_payments_and_baskets(warehouse):
    orders = by(warehouse.dim_orders, "order_id")
    assert orders["o1"].review_score == D("1.50")
    assert orders["o2"].review_score == D("-1.00")
    assert orders["o4"].review_score == D("4.00")
    assert orders["o6"].review_score is None
    assert orders["o1"].primary_payment_type == "voucher"
    assert (orders["o1"].max_installments, orders["o1"].total_order_payment_value) == (11, D("185.00"))
    assert orders["o5"].total_order_payment_value is None
    assert (orders["o7"].basket_size, orders["o1"].basket_size) == (0, 2)


def test_products_and_sellers(warehouse):
    goods = by(warehouse.dim_products, "product_id")
    assert [goods[p].product_category for p in ("p1", "p2", "p3", "p4")] == ["toys", "", None, "moveis"]
    assert [goods[p].volume_category for p in ("p1", "p2", "p3", "p4")] == [
        "Medium", "Medium", "Unknown", "Large",
    ]
    shops = by(warehouse.dim_sellers, "seller_id")
    assert len(shops) == 3
    assert (shops["s1"].seller_city, shops["s1"].seller_state) == ("santos", "São Paulo")
    assert shops["s3"].brazil_region == "Unknown"


def test_fact_flags_and_key(warehouse):
    fact = by(warehouse.fct_sales, "order_id", "item_sequence_number")
    assert len(fact) == 8
    late = {key[0]: row.is_late for key, row in fact.items()}
    assert late == {"o0": 0, "o1": 0, "o2": 1, "o3": 0, "o4": 1, "o5": 0, "o6": 0}
    assert fact["o0", 1].purchase_date is None and fact["o0", 1].is_delivered == 0
    assert fact["o6", 1].days_to_delivery is None
    assert fact["o1", 1].days_to_delivery == 10.0
    order = sorted(fact)
    assert [fact[key].sales_key for key in order] == list(range(1, 9))


def test_fact_key_rules(spark):
    raw = market.raw(spark)
    arguments = (raw["items"], raw["orders"], raw["customers"])
    hashed = staging.fct_sales(*arguments, key="hash")
    assert hashed.select("sales_key").distinct().count() == 8
    assert "sales_key" not in staging.fct_sales(*arguments, key=None).columns
    with pytest.raises(ValueError):
        staging.fct_sales(*arguments, key="serial")


def test_monthly_growth(warehouse):
    months = warehouse.monthly_growth.orderBy("sales_month").collect()
    assert [m.sales_month_display for m in months] == ["Jan 2018", "Feb 2018", "Mar 2018"]
    assert [m.current_month_revenue for m in months] == [D("190.00"), D("220.00"), D("55.00")]
    assert [m.mom_growth_pct for m in months] == [None, D("15.79"), D("-75.00")]
    assert [m.seasonality_index for m in months] == [None, D("115.79"), D("26.83")]
    assert [m.growth_classification for m in months] == ["Initializing", "Organic/Stable", "Slow Period"]
    # One late item among two orders.
    assert months[0].late_delivery_rate_pct == D("50.00")
    assert months[2].cycle_event == "Consumer Day"


def test_baselines_and_missing_months(spark, warehouse):
    frame = spark.createDataFrame(
        [
            (dt.date(2017, month, 1), D(value))
            for month, value in ((1, "10.00"), (2, "20.00"), (6, "30.00"), (7, "40.00"))
        ],
        "sales_month date, current_month_revenue decimal(22,2)",
    )
    rolling = {r.sales_month.month: r.seasonality_index for r in growth.seasonality(frame).collect()}
    # The three rows before July are January, February and June.
    assert rolling == {1: None, 2: D("200.00"), 6: D("200.00"), 7: D("200.00")}
    overall = {r.sales_month.month: r.seasonality_index for r in growth.seasonality(frame, "global").collect()}
    assert overall == {1: D("40.00"), 2: D("80.00"), 6: D("120.00"), 7: D("160.00")}
    with pytest.raises(ValueError):
        growth.seasonality(frame, "yearly")


def test_range_is_half_open(warehouse):
    kept = growth.in_range(warehouse.fct_plain, dt.date(2018, 1, 10), dt.date(2018, 2, 1))
    assert {r.order_id for r in kept.collect()} == {"o1", "o2"}


def test_single_day_has_no_deviation(warehouse):
    days = warehouse.daily_volatility.orderBy("sales_date").collect()
    assert days[0].revenue_volatility_30d == D("0.00")
    assert days[0].revenue_average_30d == days[0].current_day_revenue == D("185.00")
    assert days[1].revenue_average_30d == D("95.00")
    assert days[1].revenue_volatility_30d == D("127.28")


def test_journey_sequence_runs_over_items(warehouse):
    journey = by(warehouse.customer_journey, "customer_unique_id")
    # The customer without items and the item without a customer are gone.
    assert set(journey) == {"u1", "u2", "u3", "u4", "u5"}
    first = journey["u1"]
    # The second item row is still the first order, so no return is seen.
    assert (first.second_order_date, first.is_returned_90d) == (dt.date(2018, 1, 10), 0)
    assert first.total_lifetime_orders == 2
    assert first.first_order_review_score == D("1.50")
    assert first.customer_lifespan_days == 1
    assert journey["u2"].second_order_date is None
    # The last purchase date of the fact is 6 March.
    assert journey["u2"].recency_days == 33


def test_journey_counts_a_return_of_single_items(spark):
    raw = market.raw(
        spark,
        items=[market.item("o1", 1), market.item("o2", 1)],
    )
    journey = by(Warehouse.from_raw(raw).customer_journey, "customer_unique_id")
    assert journey["u1"].second_order_date == dt.date(2018, 1, 11)
    assert journey["u1"].is_returned_90d == 1


def test_winback(spark):
    frame = spark.createDataFrame(
        [
            ("a", 1, D("4.00"), D("300.00"), 1), ("b", 1, D("3.99"), D("300.00"), 0),
            ("c", 0, D("5.00"), D("300.00"), 0), ("d", 1, D("5.00"), D("300.00"), 0),
            ("e", 1, D("5.00"), D("10.00"), 0), ("f", 1, None, D("300.00"), 0),
        ],
        "customer_unique_id string, is_churned int, first_order_review_score decimal(6,2),"
        " total_lifetime_revenue decimal(22,2), is_repeat_buyer int",
    )
    for name in ("customer_city", "customer_state", "first_order_date", "recent_order_date"):
        frame = frame.withColumn(name, F.lit("x"))
    frame = frame.withColumns({"recency_days": F.lit(200), "total_lifetime_orders": F.lit(1)})
    rows = customers.winback_segmentation(frame).collect()
    assert [(r.customer_unique_id, r.recovery_priority) for r in rows] == [
        ("a", "High Priority: Lapsed Loyal"), ("d", "Medium Priority: Lapsed One-Time"),
    ]


def test_winback_needs_more_than_the_mean(spark):
    frame = spark.createDataFrame([(D("5.00"),), (D("5.00"),)], "total_lifetime_revenue decimal(22,2)")
    names = "customer_unique_id customer_city customer_state first_order_date recent_order_date"
    frame = frame.withColumns(
        {
            **{name: F.lit("x") for name in names.split()},
            "is_churned": F.lit(1), "is_repeat_buyer": F.lit(0), "recency_days": F.lit(200),
            "first_order_review_score": F.lit(D("5.00")), "total_lifetime_orders": F.lit(1),
        }
    )
    assert customers.winback_segmentation(frame).count() == 0


def test_category_metrics(spark, warehouse):
    rows = by(
        products.category_metrics(warehouse.fct_plain, warehouse.dim_products, warehouse.dim_orders),
        "product_category",
    )
    # The item without an order adds no revenue; p9 has no product row.
    assert set(rows) == {"toys", "", None, "moveis"}
    assert rows["toys"].total_revenue == D("253.00")
    assert (rows["toys"].total_orders, rows["toys"].total_reviews) == (3, 2)
    # A mean score of 1.5 is no one-star review; -1 drags the mean down.
    assert rows["toys"].one_star_count == 0
    assert rows[None].avg_review_score == D("-1")


def test_matrix_drops_missing_category_after_the_mean(warehouse):
    rows = by(warehouse.product_quality_matrix, "product_category")
    assert set(rows) == {"toys", "", "moveis"}
    # Mean over four groups: (253 + 75 + 110 + 5) / 4 = 110.75.
    assert rows["moveis"].matrix_position == "Niche Winners"
    assert rows["toys"].matrix_position == "Revenue Traps"
    assert rows["toys"].lifecycle_status == "New"


def test_equal_revenue_shares_the_running_total(spark):
    raw = market.raw(
        spark,
        items=[
            market.item("o1", 1, "p1"),
            market.item("o3", 1, "p4"),
            market.item("o4", 1, "p2", price="20.00", freight="0.00"),
        ],
    )
    rows = by(Warehouse.from_raw(raw).product_quality_matrix, "product_category")
    # 110 + 110 of 240 at once: both are at 91.7 %.
    assert {rows["toys"].revenue_segment, rows["moveis"].revenue_segment} == {"Long Tail"}


def test_unit_economics(warehouse):
    rows = by(warehouse.unit_economics, "sales_key")
    assert len(rows) == 8
    # Sorted by order: o0, o1 (2), o2, o3, o4, o5, o6.
    free = rows[4]
    assert (free.price, free.freight_ratio, free.freight_ratio_bucket) == (D("0.00"), None, "50%+ (Critical)")
    assert free.review_score is None
    # The unknown seller s9 forms a group of its own.
    lonely = rows[7]
    assert (lonely.brazil_region, lonely.regional_efficiency_index) == (None, D("1.00"))
    assert lonely.installment_group == "Long-term (10+)"
    # Southeast: freight 7 + 10 + 5 + 10 + 2 over five items.
    assert rows[1].regional_avg_freight == D("6.80")
    assert rows[1].regional_efficiency_index == D("1.03")
    assert rows[2].transaction_efficiency_status == "Expensive Transaction"


def test_risk_map(warehouse):
    rows = by(warehouse.strategic_risk_map, "product_category", "seller_id", "customer_state")
    # Unknown product, seller, customer and order all drop out.
    assert sum(r.total_category_orders for r in rows.values()) == 5
    blank = rows["Uncategorized", "s2", "Unknown"]
    assert blank.seller_revenue_rank == 0.0
    assert blank.transit_lane == "Rio Grande do Norte -> Unknown"
    assert rows["moveis", "s3", "Rio Grande do Norte"].shipping_type == "Cross-Region"
    toys = rows["toys", "s1", "Unknown"]
    assert (toys.total_category_orders, toys.total_late_orders) == (2, 1)
    # One order at 1.5 and one at 4.
    assert (toys.avg_lane_review, toys.strategic_risk_status) == (D("2.75"), "Critical Risk Lane")


def test_executive_summary(warehouse):
    months = warehouse.executive_summary.orderBy("sales_month").collect()
    assert [m.canceled_revenue_loss for m in months] == [D("0.00"), D("0.00"), D("33.00")]
    # January: 1.5, the sentinel does not count.
    assert [m.avg_review_score for m in months] == [D("1.50"), D("4.50"), None]
    assert [m.fulfillment_ratio_pct for m in months] == [D("100.00"), D("100.00"), D("33.33")]
    assert [m.business_health_status for m in months] == ["Stable", "Efficient Scaling", "Contraction"]
    product_only = executive.executive_summary(
        warehouse.monthly_growth, warehouse.dim_orders, warehouse.fct_plain,
        warehouse.start, warehouse.end, lost_measure="price",
    )
    assert max(m.canceled_revenue_loss for m in product_only.collect()) == D("30.00")


def test_lost_revenue_covers_whole_months(warehouse):
    # The range ends before the cancellation on 5 March, its month counts.
    start, end = dt.date(2018, 1, 1), dt.date(2018, 3, 5)
    summary = executive.executive_summary(
        growth.monthly_growth(warehouse.fct_plain, start, dt.date(2018, 4, 1)),
        warehouse.dim_orders, warehouse.fct_plain, start, end,
    )
    assert max(m.canceled_revenue_loss for m in summary.collect()) == D("33.00")


def test_free_category_has_ratio_over_zero_guarded(spark):
    raw = market.raw(spark, items=[market.item("o1", 1, price="0.00", freight="0.00")])
    warehouse = Warehouse.from_raw(raw, start=dt.date(2018, 1, 1), end=dt.date(2018, 3, 1))
    month = warehouse.monthly_growth.first()
    assert month.current_month_revenue == D("0.00")
    line = logistics.unit_economics(
        warehouse.fct_sales, warehouse.dim_orders, warehouse.dim_sellers
    ).first()
    assert line.freight_ratio is None and line.regional_efficiency_index is None
    assert line.transaction_efficiency_status == "Regional Baseline"
    assert risk.seller_lanes(
        warehouse.fct_plain, warehouse.dim_products, warehouse.dim_sellers,
        warehouse.dim_customers, warehouse.dim_orders,
    ).count() == 1


def test_lanes_are_the_same_where_customers_meet_orders(spark):
    """Orders, customers and products that come twice, and NULLs, multiply and drop out alike."""
    base = market.BASE
    raw = market.raw(
        spark,
        orders=[*base["orders"], *base["orders"][:2], market.order(None, "c1", "2018-02-01 08:00:00"),
                market.order("o8", None, "2018-02-01 08:00:00"), market.order("o8", "c8", None)],
        customers=[*base["customers"], ("c1", "u2", "natal", "RN"), ("c8", None, "x", "SP"), (None, "u9", "x", None)],
        items=[*base["items"], market.item(None, 1), market.item("o8", 1), market.item("o1", 3, price="1.00"),
               ("o3", 2, "p4", "s3", None, D("1.00")), ("o3", 3, None, "s3", D("1.00"), D("1.00")),
               ("o4", 4, "p1", None, D("1.00"), D("1.00"))],
        products=[*base["products"], ("p1", "moveis", 100, 10, 10, 50)],
    )
    with Warehouse.from_raw(raw) as warehouse:
        tables = [getattr(warehouse, f"dim_{name}") for name in ("products", "sellers", "customers", "orders")]
        # Places whose names are NULL, as another source may have them.
        nameless = F.when(F.col("customer_unique_id") != "u2", F.col("brazil_region"))
        tables[2] = tables[2].withColumn("brazil_region", nameless)
        plain = risk.strategic_risk_map(warehouse.fct_plain, *tables)
        early = risk.strategic_risk_map(
            warehouse.fct_plain, *tables, write=warehouse._write, with_people=warehouse._with_people()
        )
        assert early.columns == plain.columns
        rows = sorted(map(repr, early.collect()))
        assert rows == sorted(map(repr, plain.collect()))
        assert {row.customer_region for row in plain.collect()} >= {None}
        # By hand: items and orders, customers and products joined row by row.
        fact = warehouse.fct_plain
        lines = (
            fact.join(tables[3].select("order_id"), "order_id")
            .join(tables[2].select("customer_unique_id"), "customer_unique_id")
            .join(tables[0].select("product_id"), "product_id")
            .join(tables[1].select("seller_id"), "seller_id")
        )
        assert sum(row.total_category_orders for row in early.collect()) == lines.count() > 20


def test_names_and_their_numbers(spark):
    rows = [("a", None), ("a", None), (None, "b"), (None, None), ("a", "b"), ("", "b")]
    frame = spark.createDataFrame(rows, "s string, r string")
    known = numbered_names(frame, ["s", "r"], "n")
    assert sorted(row.n for row in known.collect()) == [1, 2, 3, 4, 5]
    numbers = name_numbers(frame, known, ["s", "r"], "n").drop("s", "r")
    back = names_of_numbers(numbers, known, "n").select("s", "r").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(rows, key=repr)
