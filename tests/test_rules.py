"""Both sides of every cut-off, and NULLs."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.exact import ratio


def evaluate(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + schema)
    return [row[0] for row in frame.orderBy("i").select(column).collect()]


c = F.col


def test_size_bucket(spark):
    volumes = [(None,), (4999,), (5000,), (20000,), (20001,), (50000,), (50001,)]
    assert evaluate(spark, volumes, "v int", rules.size_bucket(c("v"))) == [
        "Unknown", "Small", "Medium", "Medium", "Large", "Large", "Extra Large",
    ]


@pytest.mark.parametrize(
    "revenue, total, label",
    [
        ("120.00", "100.00", "Organic/Stable"),
        ("120.01", "100.00", "Seasonal Peak"),
        ("80.00", "100.00", "Organic/Stable"),
        ("79.99", "100.00", "Slow Period"),
        ("50.00", None, "Initializing"),
        ("50.00", "0.00", "Organic/Stable"),
    ],
)
def test_growth_class(spark, revenue, total, label):
    rows = [(D(revenue), total and D(total))]
    column = rules.growth_class(ratio(c("r"), c("t")), c("t"))
    assert evaluate(spark, rows, "r decimal(22,2), t decimal(22,2)", column) == [label]


def test_calendar_event(spark):
    days = [("2018-11-30",), ("2018-12-01",), ("2018-03-15",), ("2018-04-01",)]
    assert evaluate(spark, days, "d string", rules.calendar_event(c("d").cast("date"))) == [
        "Black Friday", "Holiday Season", "Consumer Day", "Regular",
    ]


def test_health_status(spark):
    rows = [
        (D("1.00"), D("3.92"), D("4.00"), "Stable"),
        (D("1.00"), D("3.91"), D("4.00"), "Toxic Growth"),
        (D("1.00"), D("4.00"), D("4.00"), "Efficient Scaling"),
        (D("-0.01"), D("4.00"), D("1.00"), "Contraction"),
        (D("0.00"), D("4.00"), D("1.00"), "Stable"),
        (None, D("4.00"), None, "Stable"),
        (D("1.00"), None, D("4.00"), "Stable"),
    ]
    column = rules.health_status(c("g"), c("s"), c("p"))
    schema = "g decimal(9,2), s decimal(20,14), p decimal(20,14), want string"
    assert evaluate(spark, rows, schema, column) == [row[3] for row in rows]


def test_return_and_churn(spark):
    rows = [
        ("2018-01-01", "2018-01-01"), ("2018-01-01", "2018-01-02"), ("2018-01-01", "2018-04-01"),
        ("2018-01-01", "2018-04-02"), ("2018-01-02", "2018-01-01"), ("2018-01-01", None),
    ]
    column = rules.returned_within(c("a").cast("date"), c("b").cast("date"))
    assert evaluate(spark, rows, "a string, b string", column) == [0, 1, 1, 0, 0, 0]
    recency = [(180,), (181,), (None,)]
    assert evaluate(spark, recency, "r int", rules.churned(c("r"))) == [0, 1, 0]


def test_pareto_segment(spark):
    rows = [(D("80.00"), D("100.00")), (D("80.01"), D("100.00"))]
    column = rules.pareto_segment(c("a"), c("b"))
    assert evaluate(spark, rows, "a decimal(22,2), b decimal(22,2)", column) == [
        "Pareto Driver (Top 80%)", "Long Tail",
    ]


def test_quadrant(spark):
    mean = D("100.00")
    rows = [
        (D("100.01"), mean, D("4.0"), "Core Strengths"),
        (D("100.00"), mean, D("4.0"), "Niche Winners"),
        (D("100.01"), mean, D("3.99"), "Underperformers"),
        (D("100.01"), mean, D("3.5"), "Underperformers"),
        (D("100.01"), mean, D("3.49"), "Revenue Traps"),
        (D("1.00"), mean, D("3.49"), "Underperformers"),
        (D("100.01"), mean, D("-1"), "Revenue Traps"),
        (D("100.01"), mean, None, "Underperformers"),
    ]
    schema = "r decimal(22,2), m decimal(22,2), s decimal(20,14), want string"
    column = rules.quadrant(c("r"), c("m"), c("s"))
    assert evaluate(spark, rows, schema, column) == [row[3] for row in rows]


def test_lifecycle(spark):
    rows = [
        (D("5.00"), D("0.00"), "New"), (D("0.00"), D("0.00"), "New"),
        (D("120.00"), D("100.00"), "Stable"), (D("120.01"), D("100.00"), "Emerging"),
        (D("90.00"), D("100.00"), "Stable"), (D("89.99"), D("100.00"), "Declining"),
    ]
    column = rules.lifecycle(c("a"), c("b"))
    schema = "a decimal(22,2), b decimal(22,2), want string"
    assert evaluate(spark, rows, schema, column) == [row[2] for row in rows]


def test_time_bands(spark):
    # Relative to 30 September: day 90 is 2 July, day 180 is 3 April.
    rows = [("2018-07-02",), ("2018-07-01",), ("2018-04-03",), ("2018-04-02",), (None,)]
    last, day = F.lit("2018-09-30").cast("date"), c("d").cast("date")
    assert evaluate(spark, rows, "d string", rules.recent_band(day, last)) == [
        True, False, False, False, None,
    ]
    assert evaluate(spark, rows, "d string", rules.previous_band(day, last)) == [
        False, True, True, False, None,
    ]


def test_freight_rules(spark):
    rows = [(D("0.1000"),), (D("0.1001"),), (D("0.2000"),), (D("0.5000"),), (D("0.5001"),), (None,)]
    assert evaluate(spark, rows, "r decimal(12,4)", rules.freight_bucket(c("r"))) == [
        "0-10% (Low)", "10-20% (Mid)", "10-20% (Mid)", "20-50% (High)", "50%+ (Critical)",
        "50%+ (Critical)",
    ]
    rows = [(D("0.89"),), (D("0.90"),), (D("1.10"),), (D("1.11"),), (D("1.50"),), (D("1.51"),), (None,)]
    assert evaluate(spark, rows, "r decimal(12,2)", rules.efficiency_status(c("r"))) == [
        "Efficient Transaction", "Regional Baseline", "Regional Baseline",
        "Expensive Transaction", "Expensive Transaction", "Critical Outlier (>1.5x Avg)",
        "Regional Baseline",
    ]
    rows = [(0,), (1,), (2,), (5,), (6,), (10,), (11,), (None,)]
    assert evaluate(spark, rows, "n int", rules.installment_group(c("n"))) == [
        "Single Pay", "Single Pay", "Short-term (2-5)", "Short-term (2-5)", "Mid-term (6-10)",
        "Mid-term (6-10)", "Long-term (10+)", "Long-term (10+)",
    ]


def test_lane_rules(spark):
    rows = [
        (21, 100, D("3.49"), "Critical Risk Lane"), (20, 100, D("3.49"), "Logistical Bottleneck"),
        (21, 100, D("3.5"), "Logistical Bottleneck"), (21, 100, None, "Logistical Bottleneck"),
        (15, 100, D("1.0"), "Stable Lane"), (16, 100, D("5.0"), "Logistical Bottleneck"),
    ]
    schema = "l bigint, n bigint, s decimal(20,14), want string"
    column = rules.lane_risk(c("l"), c("n"), c("s"))
    assert evaluate(spark, rows, schema, column) == [row[3] for row in rows]
    rows = [("North", "North"), ("North", "South"), (None, "South"), (None, None), ("Unknown", "Unknown")]
    assert evaluate(spark, rows, "a string, b string", rules.shipping_type(c("a"), c("b"))) == [
        "Intra-Region", "Cross-Region", "Cross-Region", "Cross-Region", "Intra-Region",
    ]
    rows = [(0.05,), (0.0500001,), (0.0,)]
    assert evaluate(spark, rows, "r double", rules.dependency_segment(c("r"))) == [
        "High Dependency Seller (Top 5%)", "Long Tail Seller", "High Dependency Seller (Top 5%)",
    ]
    rows = [("SP", "RJ"), (None, "RJ")]
    assert evaluate(spark, rows, "a string, b string", rules.transit_lane(c("a"), c("b"))) == [
        "SP -> RJ", None,
    ]


def test_categories_and_toxicity(spark):
    rows = [("toys", "x"), ("", "x"), (None, "x"), (None, None), ("", "")]
    assert evaluate(spark, rows, "e string, o string", rules.category_name(c("e"), c("o"))) == [
        "toys", "x", "x", None, "",
    ]
    assert evaluate(spark, rows, "e string, o string", rules.filled_category(c("e"))) == [
        "toys", "Uncategorized", "Uncategorized", "Uncategorized", "Uncategorized",
    ]
    rows = [(1, 3), (0, 5), (0, 0)]
    assert evaluate(spark, rows, "a bigint, b bigint", rules.toxicity_percent(c("a"), c("b"))) == [
        D("33.33"), D("0.00"), None,
    ]
    guarded = rules.toxicity_percent(c("a"), c("b"), minimum_reviews=4)
    assert evaluate(spark, rows, "a bigint, b bigint", guarded) == [None, D("0.00"), None]
