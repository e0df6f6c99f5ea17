"""The star schema and the marts over it, under one roof."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.rules import DEFAULTS, Cutoffs
from mercato.operators.durable import OwnedTables
from mercato.plans import customers, executive, growth, logistics, products, risk, staging
from mercato.sources.tables import publish, write_dimension, write_fact, write_orders

# The analysis range of the original data.
START, END = dt.date(2017, 1, 1), dt.date(2018, 9, 1)

DIMENSIONS = ("dim_customers", "dim_orders", "dim_products", "dim_sellers")


class Warehouse:
    """Five staging tables and eight marts, each built when first asked for.

    ``Warehouse.from_raw`` plans everything from the raw tables;
    ``Warehouse.from_staged`` reads tables that ``stage`` has written. Marts
    that do not show ``sales_key`` read ``fct_plain``, which has no key to
    compute.

    A ``durable`` warehouse writes what its marts read repeatedly, once, to a
    folder of its own, when such a mart is first asked for: the fact, the
    journeys, the lanes. ``close`` (or the end of a ``with`` block) removes these
    tables, and with them what was built on them. One over raw tables is durable
    by itself, one over staged tables only if asked: without, it starts no job
    and writes nothing before a mart is read.
    """

    def __init__(
        self,
        start: dt.date = START,
        end: dt.date = END,
        cut: Cutoffs = DEFAULTS,
        baseline: str = "rolling",
        lost_measure: str = "item_total_value",
        minimum_reviews: int = 0,
    ):
        self.start, self.end, self.cut, self.baseline = start, end, cut, baseline
        self.lost_measure, self.minimum_reviews = lost_measure, minimum_reviews
        self.durable = True
        self._raw: Mapping[str, DataFrame] | None = None
        self._tables: OwnedTables | None = None
        self._lock = RLock()

    @classmethod
    def from_raw(
        cls,
        raw: Mapping[str, DataFrame],
        key: str = "row_number",
        location: str = "last_by_name",
        hash_columns: tuple[str, ...] = staging.HASH_COLUMNS,
        **options,
    ) -> "Warehouse":
        self = cls(**options)
        self._raw, self._key, self._location = raw, key, location
        self._hash_columns = hash_columns
        return self

    @classmethod
    def from_staged(
        cls, spark: SparkSession, folder: str, durable: bool = False, **options
    ) -> "Warehouse":
        self = StagedWarehouse(**options)
        self._spark, self._folder, self.durable = spark, folder, durable
        return self

    # Tables of its own

    def _write(self, df: DataFrame, label: str) -> DataFrame:
        with self._lock:
            if self._tables is None:
                self._tables = OwnedTables(df.sparkSession, "warehouse")
            tables = self._tables
            self._written = getattr(self, "_written", 0) + 1
            name = f"{label}-{self._written}"
        return tables.write(df, name)

    @property
    def _keep(self):
        return self._write if self.durable else None

    def close(self) -> None:
        """Remove the tables this warehouse has written for its marts."""
        if self._tables is not None:
            self._tables.close()
            self._tables = None

    def __enter__(self) -> "Warehouse":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Staging

    @cached_property
    def dim_customers(self) -> DataFrame:
        return staging.dim_customers(self._raw["customers"], self._raw["orders"], self._location)

    @cached_property
    def dim_orders(self) -> DataFrame:
        raw = self._raw
        return staging.dim_orders(raw["orders"], raw["payments"], raw["reviews"], raw["items"])

    @cached_property
    def dim_products(self) -> DataFrame:
        return staging.dim_products(self._raw["products"], self._raw["translation"])

    @cached_property
    def dim_sellers(self) -> DataFrame:
        return staging.dim_sellers(self._raw["sellers"])

    #: Raw tables, with the columns read of them where these are few, that make each dimension.
    SOURCES = {
        "dim_customers": {"customers": None, "orders": ("customer_id", "order_purchase_timestamp")},
        "dim_products": {"products": None, "translation": None},
        "dim_sellers": {"sellers": None},
    }

    def sources_of(self, dimension: str) -> dict[str, DataFrame]:
        """What a dimension of a warehouse over raw tables is made from."""
        return {
            name: self._raw[name].select(*columns) if columns else self._raw[name]
            for name, columns in self.SOURCES[dimension].items()
        }

    def of_orders(self, chosen: Callable[[DataFrame], DataFrame], few: int) -> "Warehouse":
        """A warehouse whose fact and orders hold at least what there is of the chosen orders.

        Of no more than ``few`` orders the ids are sent to all tasks, and what belongs to other
        orders is left out before anything is shuffled. Row numbers count all items, so
        with them, as with more orders, it is this warehouse.
        """
        ids = chosen(self._raw["orders"]).select("order_id")
        if self._key == "row_number" or ids.count() > few:
            return self
        raw = dict(self._raw)
        for name in ("items", "payments", "reviews"):
            raw[name] = raw[name].join(F.broadcast(ids), "order_id", "left_semi")
        options = {name: getattr(self, name) for name in ("start", "end", "cut", "baseline", "lost_measure", "minimum_reviews")}
        return Warehouse.from_raw(raw, self._key, self._location, self._hash_columns, **options)

    @property
    def location(self) -> str:
        return self._location

    def fact_to_gather(self, gather: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``gather`` of the fact: its hash key is added afterwards and is no part of the shuffle."""
        if self._key == "hash":
            keyed = staging.keyed_later(gather(self.fct_plain), self._hash_columns)
            if keyed is not None:
                return keyed
        return gather(self.fct_sales)

    def _fact(
        self, key: str | None, numbered: bool = False, people: DataFrame | None = None
    ) -> DataFrame:
        raw = self._raw
        return staging.fct_sales(
            raw["items"], raw["orders"], raw["customers"], key, self._hash_columns, self._write, numbered, people
        )

    def _with_people(self) -> risk.WithPeople | None:
        """The fact with columns of customers, which over raw tables meet the orders and not the items."""
        return None if self._raw is None else lambda people: self._fact(None, people=people)

    @cached_property
    def fct_sales(self) -> DataFrame:
        return self._fact(self._key)

    @cached_property
    def fct_plain(self) -> DataFrame:
        return self._fact(None)

    @cached_property
    def fct_reread(self) -> DataFrame:
        """The fact for marts that read it several times.

        Joining it anew for every read would shuffle all items again, so it is
        written once for all these marts.
        """
        return self._write(self.fct_plain, "fact")

    def stage(self, folder: str) -> None:
        """Write the five staging tables below ``folder``, side by side, and the daily sales."""
        with ThreadPoolExecutor(len(DIMENSIONS) + 1) as pool:
            jobs = [pool.submit(self._stage_fact, folder)] + [
                pool.submit(self._stage_dimension, name, folder) for name in DIMENSIONS
            ]
        for job in jobs:
            job.result()

    def _stage_fact(self, folder: str) -> None:
        fact = self._fact(self._key, numbered=True)
        write_fact(fact, f"{folder}/fct_sales")
        stored = fact.sparkSession.read.schema(fact.schema).parquet(f"{folder}/fct_sales")
        write_dimension(growth.daily_sales(stored), f"{folder}/daily_sales")

    def _stage_dimension(self, name: str, folder: str) -> None:
        write = write_orders if name == "dim_orders" else write_dimension
        write(getattr(self, name), f"{folder}/{name}")

    # Marts

    def _over_time(self, fact: str) -> DataFrame:
        """What the totals by day and month are made from: the table ``fact``, or a smaller one in its place."""
        return getattr(self, fact)

    @cached_property
    def monthly_growth(self) -> DataFrame:
        return growth.monthly_growth(
            self._over_time("fct_plain"), self.start, self.end, self.baseline, self.cut
        )

    @cached_property
    def monthly_growth_diff(self) -> DataFrame:
        return growth.monthly_growth_diff(self._over_time("fct_plain"), self.start, self.end)

    @cached_property
    def daily_volatility(self) -> DataFrame:
        return growth.daily_volatility(self._over_time("fct_plain"), self.start, self.end)

    @cached_property
    def executive_summary(self) -> DataFrame:
        fct = self.fct_reread
        months = growth.monthly_growth(
            self._over_time("fct_reread"), self.start, self.end, self.baseline, self.cut
        )
        return executive.executive_summary(
            months, self.dim_orders, fct, self.start, self.end, self.lost_measure, self.cut
        )

    @cached_property
    def customer_journey(self) -> DataFrame:
        return self.journey(self.cut)

    def journey(self, cut: Cutoffs) -> DataFrame:
        """The customer journey with other return or churn windows."""
        return customers.customer_journey(
            self.fct_reread, self.dim_customers, self.dim_orders, cut
        )

    @cached_property
    def winback_segmentation(self) -> DataFrame:
        # The mean of all journeys is needed before any is chosen.
        journey = self.customer_journey
        if self.durable:
            journey = self._write(journey, "journey")
        return customers.winback_segmentation(journey, self.cut)

    @cached_property
    def product_quality_matrix(self) -> DataFrame:
        return self.quality_matrix(self.minimum_reviews, self.cut)

    def quality_matrix(self, minimum_reviews: int = 0, cut: Cutoffs = DEFAULTS) -> DataFrame:
        """The category matrix with other cut-offs or a guard on few reviews."""
        return products.product_quality_matrix(
            self.fct_reread, self.dim_products, self.dim_orders, minimum_reviews, cut, self._keep
        )

    @cached_property
    def unit_economics(self) -> DataFrame:
        # The only mart that shows the key, so it alone reads the fact with one several times.
        columns = ("sales_key", "order_id", "seller_id", "price", "freight_value")
        fct = self.fct_sales.select(*columns)
        if self.durable:
            fct = self._write(fct, "keyed-fact")
        return logistics.unit_economics(fct, self.dim_orders, self.dim_sellers, self.cut)

    @cached_property
    def strategic_risk_map(self) -> DataFrame:
        return risk.strategic_risk_map(
            self.fct_plain,
            self.dim_products,
            self.dim_sellers,
            self.dim_customers,
            self.dim_orders,
            self.cut,
            self._keep,
            self._with_people(),
        )

    MARTS = (
        "monthly_growth",
        "daily_volatility",
        "customer_journey",
        "winback_segmentation",
        "product_quality_matrix",
        "unit_economics",
        "strategic_risk_map",
        "executive_summary",
    )

    def publish(self, prefix: str = "") -> list[str]:
        """Register the staging tables and marts as temporary views.

        A durable warehouse writes what the marts reread, and its views show that
        state until it is published anew; one over staged tables that is not
        durable writes nothing, and its views read the staged tables as they are.
        """
        names = (*DIMENSIONS, "fct_sales", *self.MARTS)
        return publish({name: getattr(self, name) for name in names}, prefix)


def _staged(name: str) -> cached_property:
    def read(self: "StagedWarehouse") -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}")

    return cached_property(read)


class StagedWarehouse(Warehouse):
    """A warehouse over the written staging tables."""

    dim_customers = _staged("dim_customers")
    dim_orders = _staged("dim_orders")
    dim_products = _staged("dim_products")
    dim_sellers = _staged("dim_sellers")
    fct_sales = _staged("fct_sales")

    @cached_property
    def daily_sales(self) -> DataFrame:
        return self._spark.read.schema(growth.DAILY_SALES).parquet(f"{self._folder}/daily_sales")

    def _over_time(self, fact: str) -> DataFrame:
        return self.daily_sales

    @property
    def fct_plain(self) -> DataFrame:
        return self.fct_sales

    @property
    def fct_reread(self) -> DataFrame:
        return self.fct_sales
