"""Staging month by month, and marts that follow it.

``stage_months`` replaces the months it is given in the fact and in the orders, and the
dimensions whose rows have changed, under a batch id that is applied once. ``refresh``
rebuilds the marts of which an input has moved since they were written, and no other.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.dates import month_of
from mercato.plans import customers
from mercato.plans.warehouse import Warehouse
from mercato.sources.snapshots import Manifest, Snapshots, Table, updated
from mercato.sources.tables import publish

MONTH = "purchase_month"
#: The part of rows without a date, as Spark names its folder.
UNDATED = "__HIVE_DEFAULT_PARTITION__"
#: Ids of orders that every task can hold, at some 50 bytes each.
FEW_ORDERS = 2_000_000
WHOLE = ("dim_customers", "dim_products", "dim_sellers")


def _month_name(month: dt.date | None) -> str:
    return UNDATED if month is None else month.replace(day=1).isoformat()


def stage_months(
    warehouse: Warehouse, folder: str, months: Sequence[dt.date | None], batch: str
) -> Manifest:
    """Stage the given months (None: rows without a date) of a warehouse over raw tables.

    The months' rows take the place of those staged before; other months stay as
    they are. Customers, products and sellers come from all raw rows; one that is
    the same as before keeps its files. Nothing is visible before all tables are
    written. A batch that is in the manifest already does nothing. The key of the
    fact should be the ``hash`` one, which does not change as months come in.
    """
    spark = warehouse.dim_sellers.sparkSession
    store = Snapshots(spark, folder)
    base = store.manifest()
    if batch in base.batches:
        return base
    names = {_month_name(month) for month in months}
    dated = [dt.date.fromisoformat(name) for name in names if name != UNDATED]

    def chosen(rows: DataFrame) -> DataFrame:
        within = F.col(MONTH).isin(dated)
        return rows.where(within | F.col(MONTH).isNull() if UNDATED in names else within)

    def gathered(day: Column) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: chosen(rows.withColumn(MONTH, month_of(day))).hint("rebalance", MONTH)

    tables: dict[str, Table] = {}
    # Rows without a date may have no order at all, so then all orders are needed.
    part = warehouse
    if UNDATED not in names:
        part = warehouse.of_orders(lambda orders: orders.where(month_of(_order_day()).isin(dated)), FEW_ORDERS)
    by_month = {
        "fct_sales": part.fact_to_gather(gathered(F.col("purchase_date"))),
        "dim_orders": gathered(_order_day())(part.dim_orders).sortWithinPartitions(MONTH, "order_status"),
    }
    for name, rows in by_month.items():
        parts = store.write(name, rows, MONTH)
        tables[name] = updated(base.tables.get(name), rows.schema, names, parts)
    for name in WHOLE:
        sources = warehouse.sources_of(name)
        tables[name] = store.write_whole(name, getattr(warehouse, name), base.tables.get(name), sources, warehouse.location)
    return store.publish(base.with_batch(batch, tables))


def _order_day() -> Column:
    return F.col("order_purchase_timestamp").cast("date")


class SnapshotWarehouse(Warehouse):
    """The marts over one manifest's tables; stored marts stand for themselves."""

    def __init__(self, store: Snapshots, manifest: Manifest, **options) -> None:
        super().__init__(**options)
        self.store, self.manifest, self.durable = store, manifest, False

    def _table(self, name: str) -> DataFrame:
        return self.store.read(self.manifest, name)

    dim_customers = property(lambda self: self._table("dim_customers"))
    dim_orders = property(lambda self: self._table("dim_orders"))
    dim_products = property(lambda self: self._table("dim_products"))
    dim_sellers = property(lambda self: self._table("dim_sellers"))
    fct_sales = property(lambda self: self._table("fct_sales"))
    fct_plain = fct_reread = fct_sales

    @property
    def winback_segmentation(self) -> DataFrame:
        return customers.winback_segmentation(self._table(stored("customer_journey")), self.cut)


#: What each mart reads. Marts come after the marts they read.
INPUTS = {
    "monthly_growth": ("fct_sales",),
    "monthly_growth_diff": ("fct_sales",),
    "daily_volatility": ("fct_sales",),
    "customer_journey": ("fct_sales", "dim_customers", "dim_orders"),
    "winback_segmentation": ("mart_customer_journey",),
    "product_quality_matrix": ("fct_sales", "dim_products", "dim_orders"),
    "unit_economics": ("fct_sales", "dim_orders", "dim_sellers"),
    "strategic_risk_map": ("fct_sales", "dim_products", "dim_sellers", "dim_customers", "dim_orders"),
    "executive_summary": ("fct_sales", "dim_orders"),
}
#: Marts that read the months of the analysis range only.
RANGED = {"monthly_growth", "monthly_growth_diff", "daily_volatility"}


def stored(mart: str) -> str:
    return f"mart_{mart}"


def open_snapshot(spark: SparkSession, folder: str, version: int | None = None, **options) -> SnapshotWarehouse:
    store = Snapshots(spark, folder)
    return SnapshotWarehouse(store, store.manifest(version), **options)


def _inputs_of(mart: str, manifest: Manifest, warehouse: Warehouse) -> dict[str, object]:
    """What a mart is made from: the folders it reads and the options it is built with."""
    state: dict[str, object] = {
        "options": repr(
            (warehouse.start, warehouse.end, warehouse.cut, warehouse.baseline, warehouse.lost_measure, warehouse.minimum_reviews)
        )
    }
    first, last = _month_name(warehouse.start), _month_name(warehouse.end)
    for name in INPUTS[mart]:
        parts = manifest.tables[name].parts
        # The month of the end counts too: a range may end within it.
        state[name] = sorted(
            part["path"] for month, part in parts.items() if mart not in RANGED or first <= month <= last
        )
    return state


def refresh(spark: SparkSession, folder: str, marts: Iterable[str] = tuple(INPUTS), **options) -> list[str]:
    """Rebuild the stored marts whose inputs have moved; their names.

    All are published with one manifest, together with the inputs they were made from.
    """
    store = Snapshots(spark, folder)
    base = manifest = store.manifest()
    rebuilt = []
    wanted = set(marts)
    wanted |= {read.removeprefix("mart_") for mart in wanted for read in INPUTS[mart] if read.startswith("mart_")}
    for mart in [name for name in INPUTS if name in wanted]:
        warehouse = SnapshotWarehouse(store, manifest, **options)
        inputs, earlier = _inputs_of(mart, manifest, warehouse), manifest.tables.get(stored(mart))
        if earlier and earlier.notes.get("inputs") == inputs:
            continue
        table = store.write_whole(stored(mart), getattr(warehouse, mart), earlier)
        table = Table(table.schema, table.parts, {"inputs": inputs})
        manifest = Manifest(base.version, base.batches, {**manifest.tables, stored(mart): table})
        rebuilt.append(mart)
    if rebuilt:
        store.publish(Manifest(base.version + 1, base.batches, manifest.tables))
    return rebuilt


def publish_marts(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Register the stored marts of the latest manifest as temporary views."""
    store = Snapshots(spark, folder)
    manifest = store.manifest()
    marts = [name for name in INPUTS if stored(name) in manifest.tables]
    return publish({name: store.read(manifest, stored(name)) for name in marts}, prefix)
