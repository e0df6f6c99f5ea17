"""Published results of the original data, replayed from their own inputs."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.exact import percent
from mercato.plans import figures
from mercato.plans.growth import seasonality

# Month, revenue, growth %, seasonality index against the mean of
# all months, its class, review score, health status, late items, orders, late %.
MONTHS = """
2017-01-01|137188.49||17.38|Slow Period|4.06|Stable|26|789|3.30
2017-02-01|286280.62|108.68|36.27|Slow Period|4.02|Stable|62|1733|3.58
2017-03-01|432048.59|50.92|54.74|Slow Period|4.07|Efficient Scaling|163|2641|6.17
2017-04-01|412422.24|-4.54|52.25|Slow Period|4.05|Contraction|193|2391|8.07
2017-05-01|586190.95|42.13|74.27|Slow Period|4.14|Efficient Scaling|151|3660|4.13
2017-06-01|502963.04|-14.20|63.72|Slow Period|4.15|Contraction|131|3217|4.07
2017-07-01|584971.62|16.31|74.11|Slow Period|4.18|Efficient Scaling|160|3969|4.03
2017-08-01|668204.60|14.23|84.66|Organic/Stable|4.24|Efficient Scaling|151|4293|3.52
2017-09-01|720398.91|7.81|91.27|Organic/Stable|4.19|Stable|243|4243|5.73
2017-10-01|769312.37|6.79|97.47|Organic/Stable|4.12|Stable|264|4568|5.78
2017-11-01|1179143.77|53.27|149.39|Seasonal Peak|3.91|Toxic Growth|1172|7451|15.73
2017-12-01|863547.23|-26.76|109.41|Organic/Stable|4.02|Contraction|506|5624|9.00
2018-01-01|1107301.89|28.23|140.29|Seasonal Peak|4.04|Efficient Scaling|526|7220|7.29
2018-02-01|986908.96|-10.87|125.03|Seasonal Peak|3.83|Contraction|1184|6694|17.69
2018-03-01|1155126.82|17.04|146.35|Seasonal Peak|3.75|Stable|1641|7188|22.83
2018-04-01|1159698.04|0.40|146.93|Seasonal Peak|4.16|Efficient Scaling|375|6934|5.41
2018-05-01|1149781.82|-0.86|145.67|Seasonal Peak|4.19|Contraction|624|6853|9.11
2018-06-01|1022677.11|-11.05|129.57|Seasonal Peak|4.28|Contraction|94|6160|1.53
2018-07-01|1058728.03|3.53|134.13|Seasonal Peak|4.26|Stable|304|6273|4.85
2018-08-01|1003308.47|-5.23|127.11|Seasonal Peak|4.26|Contraction|739|6452|11.45
"""

# Category revenue, review score, quadrant initial (C, R, N, U) of
# the categories above the mean revenue, then of some below it.
CATEGORIES = """
1441248.07 4.14 C|1305541.61 4.02 C|1241681.72 3.90 U|1156656.48 4.11 C|1059272.40 3.93 U
902511.79 3.91 U|778397.77 4.05 C|719329.95 4.15 C|685384.32 4.06 C|584219.21 4.05 C
561372.55 4.16 C|480118.00 4.01 C|453338.71 4.17 C|394883.32 3.95 U|342532.65 3.49 R
277741.71 4.20 C|253876.65 4.18 C|232799.43 4.18 C|210137.37 4.15 N|207705.09 3.84 U
206825.06 4.04 N|78374.07 4.00 N|64220.81 3.68 U|5998.54 3.82 U|954.99 4.64 N|324.51 2.50 U
"""
QUADRANTS = {
    "C": "Core Strengths", "R": "Revenue Traps", "N": "Niche Winners", "U": "Underperformers",
}
# Mean and total of all 74 categories, number of Pareto drivers.
MEAN_CATEGORY_REVENUE = D("214102.07")
TOTAL_CATEGORY_REVENUE = D("15843553.24")
PARETO_DRIVERS = 17


def months(spark):
    texts = {4, 6}  # class and health
    rows = []
    for line in MONTHS.strip().split("\n"):
        day, *values = line.split("|")
        cells = [
            value if place in texts else (D(value) if value else None)
            for place, value in enumerate(values, start=1)
        ]
        rows.append((dt.date.fromisoformat(day), *cells))
    schema = (
        "sales_month date, current_month_revenue decimal(22,2), growth decimal(9,2),"
        " seasonality decimal(9,2), class string, score decimal(9,2), health string,"
        " late decimal(9,0), orders decimal(9,0), late_pct decimal(9,2)"
    )
    return spark.createDataFrame(rows, schema)


def test_growth_late_rate_and_global_seasonality(spark):
    by_month = Window.orderBy("sales_month")
    revenue = F.col("current_month_revenue")
    before = F.lag(revenue).over(by_month)
    replay = seasonality(
        months(spark)
        .withColumn("growth_now", percent(revenue - before, before))
        .withColumn("late_now", percent(F.col("late"), F.col("orders"))),
        baseline="global",
    )
    rows = replay.collect()
    assert len(rows) == 20
    for row in rows:
        assert row.growth_now == row.growth
        assert row.late_now == row.late_pct
        assert row.seasonality_index == row.seasonality
        assert row.growth_classification == row["class"]


def test_health_status_of_each_month(spark):
    by_month = Window.orderBy("sales_month")
    status = rules.health_status(
        F.col("growth"), F.col("score"), F.lag("score").over(by_month)
    )
    rows = months(spark).withColumn("now", status).collect()
    wrong = {row.sales_month for row in rows if row.now != row.health}
    # The published scores have two digits; March 2018 lies between 3.75 and
    # 0.98 * 3.83 and was decided by the digits behind.
    assert wrong == {dt.date(2018, 3, 1)}


def test_published_figures(spark):
    frame = months(spark).withColumns(
        {
            "mom_growth_pct": F.col("growth"),
            "late_delivery_rate_pct": F.col("late_pct"),
            "late_deliveries": F.col("late"),
            "total_orders": F.col("orders"),
            "avg_review_score": F.col("score"),
            "business_health_status": F.col("health"),
        }
    )
    assert figures.total_revenue(frame).first()[0] == D("15786203.57")
    assert figures.average_review(frame).first()[0] == D("4.10")
    assert figures.average_growth(frame).first()[0] == D("14.52")
    late = figures.late_rate(frame).first()
    assert (late.mean_monthly_late_pct, late.overall_late_pct) == (D("7.66"), D("8.85"))
    counts = {row[0]: row[1] for row in figures.months_by_health(frame).collect()}
    assert counts["Toxic Growth"] == 1


def categories(spark):
    entries = [cell.split() for line in CATEGORIES.strip().split("\n") for cell in line.split("|")]
    rows = [(D(revenue), D(score), QUADRANTS[label]) for revenue, score, label in entries]
    return spark.createDataFrame(
        rows, "revenue decimal(22,2), score decimal(9,2), want string"
    )


def test_quadrants_of_categories(spark):
    now = rules.quadrant(F.col("revenue"), F.lit(MEAN_CATEGORY_REVENUE), F.col("score"))
    for row in categories(spark).withColumn("now", now).collect():
        assert row.now == row.want, row


def test_pareto_drivers(spark):
    running = F.sum("revenue").over(Window.orderBy(F.col("revenue").desc()))
    segment = rules.pareto_segment(running, F.lit(TOTAL_CATEGORY_REVENUE))
    rows = (
        categories(spark)
        .where(F.col("revenue") > 210_000)
        .withColumn("segment", segment)
        .orderBy(F.col("revenue").desc())
        .collect()
    )
    drivers = [row.segment == "Pareto Driver (Top 80%)" for row in rows]
    assert drivers == [True] * PARETO_DRIVERS + [False] * (len(rows) - PARETO_DRIVERS)
