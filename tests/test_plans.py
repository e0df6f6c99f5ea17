"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as contract
from mercato.catalog import REGISTRY, open_warehouse
from mercato.operators.durable import new_path
from mercato.operators.ranking import percent_rank_desc
from mercato.plans import executive, growth, products, risk
from mercato.plans.warehouse import Warehouse
from mercato.sources.retail import RANGE_END, RANGE_START, RetailTables

MARTS = [*Warehouse.MARTS, "monthly_growth_diff", "fct_sales", "dim_customers", "dim_orders"]


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def planned(frame) -> str:
    """The plan before it ran; one that has run shows both."""
    return plan_of(frame).split("== Initial Plan ==")[-1]


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    folder = new_path(spark, "plan-tests")
    raw = RetailTables(spark, sf_dir)
    Warehouse.from_raw(raw, start=RANGE_START, end=RANGE_END).stage(folder)
    return Warehouse.from_staged(spark, folder, start=RANGE_START, end=RANGE_END)


@pytest.mark.parametrize("name", MARTS)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(REGISTRY[name].build(open_warehouse(spark, sf_dir)))
    assert not re.search("NestedLoop|Cartesian|Python|ArrowEval|MapInPandas", plan)


@pytest.mark.parametrize("name", ["fct_sales", "customer_journey", "unit_economics", "strategic_risk_map"])
def test_no_single_partition_over_detail_rows(spark, sf_dir, name):
    plan = plan_of(REGISTRY[name].build(open_warehouse(spark, sf_dir)))
    # Slice sizes and single figures may meet in one task, rows may not: a
    # single partition is fed by an aggregate only.
    lines = plan.split("\n")
    for place, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[place + 1], lines[place + 1]


def test_explicit_broadcasts_are_aggregates(staged):
    """Hinted broadcasts hold months, slices or regions."""
    for name in ("executive_summary", "unit_economics"):
        plan = getattr(staged, name)._jdf.queryExecution().optimizedPlan().toString()
        for chunk in plan.split("\n"):
            if "strategy=broadcast" in chunk:
                assert re.search("sales_month|_slice|brazil_region", chunk), chunk


def test_date_range_prunes_month_folders_and_columns(staged):
    plan = plan_of(growth.month_totals(staged.fct_plain, RANGE_START, RANGE_END))
    assert re.search(r"PartitionFilters: \[[^\]]*purchase_month", plan)
    assert re.search(r"PushedFilters: \[[^\]]*purchase_date", plan)
    schema = re.search(r"ReadSchema: struct<([^\n]*)", plan).group(1)
    assert "seller_id" not in schema and "sales_key" not in schema


def test_unused_payment_and_review_joins_are_dropped(spark, sf_dir):
    warehouse = open_warehouse(spark, sf_dir)
    plan = plan_of(warehouse.dim_orders.select("order_id", "order_status"))
    assert "Join" not in plan


def test_fact_join_shuffles_items_once(spark, sf_dir):
    plan = plan_of(open_warehouse(spark, sf_dir).fct_plain)
    assert plan.count("Exchange hashpartitioning(order_id") == 2
    assert plan.count("Exchange hashpartitioning(customer_id") == 2


def test_distinct_orders_need_no_shuffle_after_the_fact_join(spark, sf_dir):
    warehouse = open_warehouse(spark, sf_dir)
    plan = plan_of(growth.month_totals(warehouse.fct_plain, RANGE_START, RANGE_END))
    assert "hashpartitioning(sales_month" in plan
    assert not re.search(r"hashpartitioning\(sales_month#\d+, order_id", plan)


def test_staged_marts_equal_marts_from_raw(spark, sf_dir, staged):
    raw = RetailTables(spark, sf_dir)
    direct = Warehouse.from_raw(raw, start=RANGE_START, end=RANGE_END)
    for name in Warehouse.MARTS:
        left, right = getattr(direct, name), getattr(staged, name)
        assert left.columns == right.columns
        assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect())), name


def fact_exchanges(frame, *columns: str) -> int:
    """Exchanges on exactly these columns anywhere in the plan."""
    keys = ", ".join(rf"{column}#\d+L?" for column in columns)
    return len(re.findall(rf"Exchange hashpartitioning\({keys}, \d+\)", plan_of(frame)))


def test_leakage_shuffles_the_fact_once(staged):
    lost = executive.canceled_revenue(staged.fct_sales, staged.dim_orders)
    # One for the fact, one for the canceled orders.
    assert fact_exchanges(lost, "order_id") == 2
    assert "order_id" not in "".join(re.findall(r"Exchange hashpartitioning\(([^)]*purchase_date[^)]*)\)", plan_of(lost)))


def test_executive_summary_from_raw_reads_the_written_fact(spark, sf_dir):
    with open_warehouse(spark, sf_dir) as warehouse:
        # The items are joined once, for the written fact; the plan reads that only.
        assert "lineitem.parquet" not in plan_of(warehouse.executive_summary)


def test_product_matrix_needs_no_shuffle_on_category_and_order(staged):
    metrics = products.category_metrics(staged.fct_sales, staged.dim_products, staged.dim_orders)
    assert fact_exchanges(metrics, "product_category") == 1
    assert fact_exchanges(metrics, "product_category", "order_id") == 0


def test_contract_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_journey_shuffles_the_fact_once(staged):
    """Item rows meet by customer, order and day; what is shuffled later is of order or customer grain."""
    plan = planned(staged.customer_journey)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", plan)
    of_items = [keys for keys in shuffles if "purchase_date" in keys]
    assert len(of_items) == 1 and "order_id" in of_items[0] and "customer_unique_id" in of_items[0]
    # The fact is scanned for the states and for its last day, and nothing sorts or windows its rows.
    assert "Window" not in plan
    lines = plan.split("\n")
    (place,) = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "purchase_date" in line]
    assert "HashAggregate" in lines[place + 1] and "partial_count" in lines[place + 1]


def test_orders_are_read_by_month_and_status(staged):
    """The month folders of the range only, and the status pushed to files that are sorted by it."""
    orders = staged.dim_orders
    assert "purchase_month" in orders.columns
    start, end = RANGE_START.replace(day=1), RANGE_START.replace(day=28)
    plan = plan_of(executive.month_sentiment(orders, start, end))
    assert re.search(r"PartitionFilters: \[[^\]]*purchase_month", plan)
    months = executive.stored_months(orders, start, end).select("purchase_month").distinct().collect()
    assert [row[0] for row in months] == [start]
    whole = planned(staged.executive_summary)
    scans = [line for line in whole.split("\n") if "FileScan" in line and "order_status" in line]
    assert len(scans) == 2 and all("purchase_month" in scan.split("PartitionFilters")[1] for scan in scans)
    assert any("EqualTo(order_status,canceled)" in scan for scan in scans)


def test_lanes_shuffle_items_by_order_product_and_lane_only(spark, sf_dir):
    """From raw tables customers meet the orders, and places travel as numbers."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with open_warehouse(spark, sf_dir) as warehouse:
            tables = [getattr(warehouse, f"dim_{name}") for name in ("products", "sellers", "customers", "orders")]
            lanes = risk.seller_lanes(warehouse.fct_plain, *tables, warehouse._with_people(), numbered=True)
            lines = planned(lanes).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shuffles = [
        (re.search(r"hashpartitioning\((.*), \d+\)", line).group(1), lines[place + 1])
        for place, line in enumerate(lines)
        if "Exchange hashpartitioning" in line
    ]
    by_customer = [below for keys, below in shuffles if re.fullmatch(r"customer_unique_id#\d+", keys)]
    assert by_customer and not any("product_id" in below for below in by_customer)
    by_product = [below for keys, below in shuffles if re.fullmatch(r"product_id#\d+L?", keys)]
    assert any("customer_place" in below for below in by_product)
    assert not any(re.search("customer_state|customer_region|price", below) for below in by_product)
    by_lane = [keys for keys, _ in shuffles if keys.startswith("product_category#")]
    assert by_lane and all("customer_place" in keys and "customer_state" not in keys for keys in by_lane)


def test_percent_rank_shuffles_counted_values_once_for_join_and_window(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("cast(id % 3 as string) as g", "cast(id % 70 as decimal(22,2)) as v")
        plan = planned(percent_rank_desc(rows, "g", "v", "rank"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    (window,) = [i for i, line in enumerate(lines) if "Window [sum(_n" in line]
    # The sort for the window lies upon the join, whose shuffle deals the values out already.
    nearest = next(line for line in lines[window + 1 :] if re.search("Exchange|Join", line))
    assert "SortMergeJoin" in nearest
