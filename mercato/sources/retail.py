"""The eight raw tables derived from TPC-H-like retail tables.

Every table is a projection of one or two source tables by integer
arithmetic; no values are drawn. No step shuffles, but for the list of
category names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
STATES = (
    "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RS SC SP XX".split()
)
PAYMENT_TYPES = ["boleto", "credit_card", "debit_card", "voucher"]
SCORES = [5, 5, 5, 5, 5, 4, 4, 3, 1, 1, 2]
RANGE_START = dt.date(1996, 1, 1)
RANGE_END = dt.date(2001, 7, 1)


def _pick(values: list, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def _cents(column: Column) -> Column:
    return F.round(column * 100).cast("bigint")


def _amount(cents: Column) -> Column:
    return (cents.cast("decimal(15,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)")


def _after(moment: Column, days: Column | int = 0, seconds: Column | int = 0) -> Column:
    return moment + F.make_dt_interval(
        days=F.lit(days).cast("int"), secs=F.lit(seconds).cast("decimal(18,6)")
    )


def raw_orders(orders: DataFrame) -> DataFrame:
    """Some October orders move to November and some February ones to March."""
    key, month = F.col("o_orderkey"), F.month("o_orderdate")
    shift = (
        F.when((month == 10) & (key % 5 < 3), 31).when((month == 2) & (key % 5 < 2), 28)
    ).otherwise(0)
    status = (
        F.when(key % 50 == 7, "canceled").when(key % 50 == 8, "shipped").otherwise("delivered")
    )
    placed, fate = F.col("_placed"), F.col("_status")
    return (
        orders.select(
            "o_orderkey",
            status.alias("_status"),
            _after(F.col("o_orderdate").cast("timestamp_ntz"), shift).alias("_day"),
        )
        .withColumn("_placed", _after(F.col("_day"), seconds=key % 86_400))
        .select(
            key.alias("order_id"),
            key.alias("customer_id"),
            fate.alias("order_status"),
            placed.alias("order_purchase_timestamp"),
            _after(placed, seconds=3600).alias("order_approved_at"),
            F.when(fate != "canceled", _after(placed, 1)).alias("order_delivered_carrier_date"),
            F.when(
                (fate == "delivered") & (key % 1000 != 1), _after(placed, 3 + (key * 7) % 23)
            ).alias("order_delivered_customer_date"),
            _after(F.col("_day"), 20).alias("order_estimated_delivery_date"),
        )
    )


def raw_customers(orders: DataFrame) -> DataFrame:
    """One account per order; every tenth belongs to a returning customer."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    person = F.when(key % 10 == 0, F.concat(F.lit("C"), owner.cast("string"))).otherwise(
        F.concat(F.lit("O"), key.cast("string"))
    )
    return orders.select(
        key.alias("customer_id"),
        person.alias("customer_unique_id"),
        F.concat(F.lit("city_"), (key % 7).cast("string")).alias("customer_city"),
        _pick(STATES, owner % len(STATES)).alias("customer_state"),
    )


def raw_payments(orders: DataFrame) -> DataFrame:
    """Up to two payments per order, from one scan."""
    key = F.col("o_orderkey")
    main = F.struct(
        _pick(PAYMENT_TYPES, key % 4).alias("payment_type"),
        (1 + key % 13).cast("int").alias("payment_installments"),
        _amount(_cents(F.col("o_totalprice"))).alias("payment_value"),
    )
    voucher = F.struct(
        F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        _amount(F.lit(1000)).alias("payment_value"),
    )
    paid = F.array(F.when(key % 500 != 9, main), F.when(key % 5 == 0, voucher))
    return orders.select(
        key.alias("order_id"), F.inline(F.filter(paid, lambda p: p.isNotNull()))
    )


def raw_reviews(orders: DataFrame) -> DataFrame:
    """Up to two reviews per order; some lack a score."""
    key = F.col("o_orderkey")
    main = F.struct(
        F.when(key % 20 != 4, _pick(SCORES, (key * 31) % len(SCORES))).alias("review_score")
    )
    second = F.struct((1 + ((key * 3) % 7) % 5).cast("int").alias("review_score"))
    given = F.array(F.when(key % 20 != 3, main), F.when(key % 25 == 5, second))
    return orders.select(
        key.alias("order_id"), F.inline(F.filter(given, lambda r: r.isNotNull()))
    )


def raw_products(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    category = F.when(key % 50 == 0, "").when(key % 50 != 1, F.col("p_name"))
    return part.select(
        key.alias("product_id"),
        category.alias("product_category_name"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        F.when(key % 97 != 0, F.col("p_size") + 10).alias("product_length_cm"),
        (5 + key % 40).cast("int").alias("product_width_cm"),
        (5 + key % 30).cast("int").alias("product_height_cm"),
    )


def raw_translation(part: DataFrame) -> DataFrame:
    name = F.col("p_name")
    english = F.when(name.startswith("red "), "").otherwise(
        F.concat(F.lit("en_"), F.replace(name, F.lit(" "), F.lit("_")))
    )
    return (
        part.where(~name.startswith("blue "))
        .select(
            name.alias("product_category_name"),
            english.alias("product_category_name_english"),
        )
        .distinct()
    )


def raw_sellers(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("seller_id"),
        F.concat(F.lit("city_"), (key % 9).cast("string")).alias("seller_city"),
        _pick(STATES, F.col("s_nationkey")).alias("seller_state"),
    )


def raw_items(lineitem: DataFrame) -> DataFrame:
    """Freight is a whole number of cents: a share of the price by tax class."""
    share = _cents(F.col("l_tax")) * 8 + 2
    price = F.when(F.col("l_partkey") % 997 == 0, F.lit(0)).otherwise(F.col("_cents"))
    return lineitem.withColumn("_cents", _cents(F.col("l_extendedprice"))).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        _amount(price).alias("price"),
        _amount(F.floor(F.col("_cents") * share / 100)).alias("freight_value"),
    )


class RetailTables(Mapping):
    """The eight raw tables over the Parquet files in a folder, each on demand."""

    # Raw table, its source file, its derivation.
    DERIVATIONS = {
        "orders": ("orders", raw_orders),
        "customers": ("orders", raw_customers),
        "items": ("lineitem", raw_items),
        "payments": ("orders", raw_payments),
        "reviews": ("orders", raw_reviews),
        "products": ("part", raw_products),
        "translation": ("part", raw_translation),
        "sellers": ("supplier", raw_sellers),
    }

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._sources: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            source, derive = self.DERIVATIONS[name]
            if source not in self._sources:
                self._sources[source] = self._spark.read.parquet(
                    f"{self._folder}/{source}.parquet"
                )
            self._tables[name] = derive(self._sources[source])
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.DERIVATIONS)

    def __len__(self) -> int:
        return len(self.DERIVATIONS)
