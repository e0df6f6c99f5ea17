"""Category revenue, quality and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.exact import MONEY, money_mean, money_mean_over, ratio
from mercato.operators.cumulative import running_total_desc
from mercato.operators.joins import large_join
from mercato.operators.ranking import Writer
from mercato.operators.statistics import figure


def category_metrics(
    fct: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    cut: rules.Cutoffs = rules.DEFAULTS,
) -> DataFrame:
    """Every figure of a category in one pass over the items.

    Revenue and reviews count items with a known order only, the two time
    bands count all items. Items are added up by category and order first:
    the join with the orders has left them partitioned by order, so this needs
    no shuffle, and distinct orders are then rows with a known order.
    """
    last_day = figure(fct, F.max("purchase_date"))
    day, value = F.col("purchase_date"), F.col("item_total_value")
    scored = orders.select("order_id", "review_score", F.lit(1).alias("_known"))
    known, score = F.col("_known") == 1, F.col("review_score")
    sold = fct.select("order_id", "product_id", "purchase_date", "item_total_value").join(
        products.select("product_id", "product_category"), "product_id"
    )
    lines = large_join(sold, scored, "order_id", "left").withColumns(
        {
            "_known_value": F.when(known, value),
            "_recent": F.when(rules.recent_band(day, last_day, cut), value).otherwise(0),
            "_previous": F.when(rules.previous_band(day, last_day, cut), value).otherwise(0),
        }
    )
    per_order = lines.groupBy("product_category", "order_id").agg(
        F.max("_known").alias("_known"),
        F.sum("_known_value").alias("_known_value"),
        F.sum(score).alias("_scores"),
        F.count(score).alias("_reviews"),
        F.count_if(score == 1).alias("_one_star"),
        F.sum("_recent").alias("_recent"),
        F.sum("_previous").alias("_previous"),
    )
    return (
        per_order.groupBy("product_category")
        .agg(
            F.sum("_known_value").cast(MONEY).alias("total_revenue"),
            F.count("_known").alias("total_orders"),
            ratio(F.sum("_scores"), F.sum("_reviews")).cast("decimal(20,14)").alias("avg_review_score"),
            F.sum("_one_star").alias("one_star_count"),
            F.sum("_reviews").alias("total_reviews"),
            F.sum("_recent").cast(MONEY).alias("recent_rev"),
            F.sum("_previous").cast(MONEY).alias("prev_rev"),
        )
        .where(F.col("total_orders") > 0)
    )


def _windowed_shares(categories: DataFrame) -> DataFrame:
    """Mean, total and running revenue of the named categories by windows."""
    revenue = F.col("total_revenue")
    everything = Window.partitionBy()
    return (
        categories.withColumn("_mean_revenue", money_mean_over(revenue, everything))
        .where(F.col("product_category").isNotNull())
        .withColumns(
            {
                "_total": F.sum(revenue).over(everything),
                "_cumulative": F.sum(revenue).over(Window.orderBy(revenue.desc_nulls_first())),
            }
        )
    )


def _shares(categories: DataFrame) -> DataFrame:
    """The same of any number of categories, which are a written table."""
    revenue = F.col("total_revenue")
    named = categories.where(F.col("product_category").isNotNull())
    return running_total_desc(named, "total_revenue", "_cumulative").withColumns(
        {
            "_mean_revenue": figure(categories, money_mean(revenue)),
            "_total": figure(named, F.sum(revenue)),
        }
    )


def product_quality_matrix(
    fct: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    minimum_reviews: int = 0,
    cut: rules.Cutoffs = rules.DEFAULTS,
    write: Writer | None = None,
) -> DataFrame:
    """Pareto class, toxicity, quadrant and lifecycle of each category.

    Categories are compared with the mean revenue of all categories including
    the missing one, which is then left out of the shares and of the result.
    With ``write`` the categories are written once and may be any number. Without,
    nothing is written, and windows over one row per category take it that
    categories, unlike products, are a list that fits one task.
    """
    revenue = F.col("total_revenue")
    categories = category_metrics(fct, products, orders, cut)
    ranked = _shares(write(categories, "categories")) if write else _windowed_shares(categories)
    score = F.col("avg_review_score")
    return ranked.select(
        "product_category",
        "total_revenue",
        "total_orders",
        rules.pareto_segment(F.col("_cumulative"), F.col("_total"), cut).alias(
            "revenue_segment"
        ),
        F.round(score, 2).alias("avg_review_score"),
        rules.toxicity_percent(
            F.col("one_star_count"), F.col("total_reviews"), minimum_reviews
        ).alias("toxicity_ratio_pct"),
        rules.quadrant(revenue, F.col("_mean_revenue"), score, cut).alias("matrix_position"),
        rules.lifecycle(F.col("recent_rev"), F.col("prev_rev"), cut).alias("lifecycle_status"),
    ).orderBy(revenue.desc_nulls_first(), "product_category")
