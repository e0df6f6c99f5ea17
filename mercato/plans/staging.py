"""The star schema: four dimensions and the order-item fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions import rules
from mercato.functions.dates import whole_days
from mercato.functions.exact import MONEY, item_value, mean
from mercato.functions.geography import region_of, state_name
from mercato.operators.joins import large_join
from mercato.operators.durable import written
from mercato.operators.ranking import Writer, ordered_index


def dim_customers(
    customers: DataFrame, orders: DataFrame, location: str = "last_by_name"
) -> DataFrame:
    """One row per ``customer_unique_id``.

    ``location`` picks the city and state: ``"last_by_name"`` takes the
    greatest name of each, ``"latest"`` those of the most recent order.
    """
    spans = orders.groupBy("customer_id").agg(
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("recent_order"),
    )
    accounts = large_join(customers, spans, "customer_id", "left")
    if location == "latest":
        place = F.max_by(
            F.struct("customer_city", "customer_state"),
            F.struct("recent_order", "customer_id"),
        )
        places = [
            place.getField("customer_city").alias("customer_city"),
            place.getField("customer_state").alias("state_code"),
        ]
    elif location == "last_by_name":
        places = [
            F.max("customer_city").alias("customer_city"),
            F.max("customer_state").alias("state_code"),
        ]
    else:
        raise ValueError(f"unknown location rule: {location}")
    people = accounts.groupBy("customer_unique_id").agg(
        *places,
        F.min("first_order").alias("first_order"),
        F.max("recent_order").alias("recent_order"),
    )
    first, recent = F.col("first_order"), F.col("recent_order")
    return people.select(
        "customer_unique_id",
        "customer_city",
        state_name(F.col("state_code")).alias("customer_state"),
        region_of(F.col("state_code")).alias("brazil_region"),
        "first_order",
        "recent_order",
        whole_days(first, recent).alias("customer_lifespan_days"),
        rules.repeat_buyer(first, recent).alias("is_repeat_buyer"),
    )


def order_payments(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").cast(MONEY).alias("total_order_payment_value"),
        F.max("payment_type").alias("primary_payment_type"),
        F.max("payment_installments").alias("max_installments"),
    )


def order_scores(reviews: DataFrame) -> DataFrame:
    """Mean review per order; -1 where every review lacks a score."""
    score = F.coalesce(mean(F.col("review_score")), F.lit(-1))
    return reviews.groupBy("order_id").agg(
        F.round(score, 2).cast("decimal(6,2)").alias("review_score")
    )


def order_baskets(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count("order_item_id").alias("basket_size"))


def dim_orders(
    orders: DataFrame, payments: DataFrame, reviews: DataFrame, items: DataFrame
) -> DataFrame:
    """One row per order; each side is reduced to that grain before its join."""
    known = orders
    for side in (order_payments(payments), order_scores(reviews), order_baskets(items)):
        known = large_join(known, side, "order_id", "left")
    return known.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "total_order_payment_value",
        "primary_payment_type",
        "max_installments",
        "review_score",
        F.coalesce("basket_size", F.lit(0)).alias("basket_size"),
    )


def dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """One row per product with its English category and size bucket."""
    named = products.join(translation, "product_category_name", "left")
    category = rules.category_name(
        F.col("product_category_name_english"), F.col("product_category_name")
    )
    sides = ("product_length_cm", "product_width_cm", "product_height_cm")
    # Three wrong lengths of metres would not fit an INT.
    length, width, height = (F.col(side).cast("bigint") for side in sides)
    volume = length * width * height
    return named.select(
        "product_id",
        category.alias("product_category"),
        "product_weight_g",
        volume.alias("volume_cm3"),
        rules.size_bucket(volume).alias("volume_category"),
    )


def dim_sellers(sellers: DataFrame) -> DataFrame:
    """One row per seller, the greatest name of its cities and states."""
    places = sellers.groupBy("seller_id").agg(
        F.max("seller_city").alias("seller_city"),
        F.max("seller_state").alias("state_code"),
    )
    return places.select(
        "seller_id",
        "seller_city",
        state_name(F.col("state_code")).alias("seller_state"),
        region_of(F.col("state_code")).alias("brazil_region"),
    )


# The first two identify an item; the others only settle ties in sources where
# the item number is not unique within its order.
ITEM_ORDER = ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"]


# What identifies an item where item numbers are unique within an order.
HASH_COLUMNS = ("order_id", "order_item_id")


def stable_key(columns: tuple[str, ...]) -> Column:
    """Digest of several columns in which NULLs and separators inside values cannot be mistaken.

    Every value is preceded by its length, a NULL is a sign of its own.
    """
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("~")))
    return F.sha2(F.concat(*parts), 256)


#: Names in the fact of columns of the items, where they differ.
FACT_NAMES = {"order_item_id": "item_sequence_number"}


def keyed_later(fct: DataFrame, columns: tuple[str, ...]) -> DataFrame | None:
    """A fact without key and its ``stable_key`` over columns of the items; None if the fact lacks one of them.

    The key is long and of random text, so it is best added when nothing is shuffled any more.
    """
    names = [FACT_NAMES.get(name, name) for name in columns]
    if not set(names) <= set(fct.columns):
        return None
    return fct.select(stable_key(tuple(names)).alias("sales_key"), *fct.columns)


def order_numbers(orders: DataFrame, write: Writer = written) -> DataFrame:
    """``order_number`` = 1..n of every order id, by first purchase, so that a day's orders lie close together."""
    known = orders.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.min("order_purchase_timestamp").alias("_first")
    )
    return ordered_index(known, ["_first", "order_id"], "order_number", write).drop("_first")


def fct_sales(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    key: str | None = "row_number",
    hash_columns: tuple[str, ...] = HASH_COLUMNS,
    write: Writer = written,
    numbered: bool = False,
    people: DataFrame | None = None,
) -> DataFrame:
    """One row per order item.

    ``key`` chooses ``sales_key``: ``"row_number"`` counts the items in order
    of order and item number, ``"hash"`` digests ``hash_columns`` and so stays
    the same when data is added (it is as unique as these columns are
    together), ``None`` leaves the column out. Marts that do
    not show the key use ``None``, as numbering needs a sort of all items.
    ``numbered`` adds ``order_number``, null where no order is known.
    ``people`` adds its columns by ``customer_unique_id``, null where it has no such row, to
    the orders, so that no item is shuffled for them. Amounts and flags are then computed
    before the joins: a mart that reads only these shuffles one column in place of two.
    """
    if key == "row_number":
        items = ordered_index(items, ITEM_ORDER, "sales_key", write)
        keys = ["sales_key"]
    elif key == "hash":
        keys = [stable_key(hash_columns).alias("sales_key")]
    elif key is None:
        keys = []
    else:
        raise ValueError(f"unknown key rule: {key}")
    # Orders meet customers first, so items are shuffled once only.
    placed = orders.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    accounts = customers.select("customer_id", "customer_unique_id")
    buyers = large_join(placed, accounts, "customer_id", "left")
    purchased = F.col("order_purchase_timestamp")
    arrived = F.col("order_delivered_customer_date")
    value = item_value(F.col("price") + F.col("freight_value"))
    late = rules.late(arrived, F.col("order_estimated_delivery_date"))
    added = []
    if people is not None:
        added = [name for name in people.columns if name != "customer_unique_id"]
        buyers = large_join(
            buyers.withColumn("_late", late), people, "customer_unique_id", "left"
        )
        items = items.withColumn("_value", value)
        # An item without an order is not late, either.
        value, late = F.col("_value"), F.coalesce("_late", F.lit(0))
    sold = large_join(items, buyers, "order_id", "left")
    if numbered:
        # The items lie by order already: only the numbers are shuffled.
        sold = large_join(sold, order_numbers(orders, write), "order_id", "left")
    return sold.select(
        *keys,
        "order_id",
        F.col("order_item_id").alias("item_sequence_number"),
        "product_id",
        "customer_unique_id",
        "seller_id",
        "price",
        "freight_value",
        value.alias("item_total_value"),
        rules.days_to_delivery(purchased, arrived).alias("days_to_delivery"),
        late.alias("is_late"),
        rules.delivered(F.col("order_status")).alias("is_delivered"),
        purchased.cast("date").alias("purchase_date"),
        *(["order_number"] if numbered else []),
        *added,
    )
