"""Queries over tables that come in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog.oracle import query, table
from mercato.catalog.marts import GROWTH_DOUBLES
from mercato.catalog.registry import RetailWarehouse as W
from mercato.catalog.registry import add
from mercato.functions.dates import month_of
from mercato.operators.append_index import AppendIndex
from mercato.operators.durable import new_path
from mercato.plans import staging
from mercato.plans.increments import open_snapshot, refresh, stage_months, stored
from mercato.plans.warehouse import Warehouse
from mercato.sources.retail import RANGE_END, RANGE_START

RANGE = {"start": RANGE_START, "end": RANGE_END}


def _months_in_batches(w: W, count: int):
    """All purchase months, every ``count``-th one in the same batch."""
    month = month_of(F.col("order_purchase_timestamp").cast("date"))
    found = [row[0] for row in w.raw["orders"].select(month.alias("month")).distinct().collect()]
    months = sorted(filter(None, found)) + [None]
    return [months[place::count] for place in range(count)]


def _incremental(w: W, mart: str, count: int = 2):
    """A mart as it is stored once its months have been staged in batches and then staged again in part."""
    folder = new_path(w.spark, "months")
    raw = Warehouse.from_raw(w.raw, key="hash", hash_columns=tuple(staging.ITEM_ORDER), **RANGE)
    batches = _months_in_batches(w, count)
    for place, months in enumerate(batches):
        stage_months(raw, folder, months, f"batch {place}")
    refresh(w.spark, folder, [mart], **RANGE)
    stage_months(raw, folder, batches[0][:2], "batch 0 again")
    refresh(w.spark, folder, [mart], **RANGE)
    snapshot = open_snapshot(w.spark, folder, **RANGE)
    return snapshot.store.read(snapshot.manifest, stored(mart))


add(
    "incremental_monthly_growth",
    "IO02 IO03 IO04 P06",
    lambda w: _incremental(w, "monthly_growth"),
    table("growth", days="sales_month", doubles=GROWTH_DOUBLES),
)


def _appended_key(w: W, batches: int = 3):
    """Items numbered as they come in three batches, which interleave."""
    index = AppendIndex(w.spark, new_path(w.spark, "sales-index"), staging.ITEM_ORDER, "sales_key", slice_rows=100_000)
    items = w.raw["items"].select(*staging.ITEM_ORDER)
    batch = F.pmod(F.xxhash64("order_id"), F.lit(batches))
    for place in range(batches):
        index.append(items.where(batch == place), f"batch {place}")
    return index.rows().select("sales_key", "order_id", "order_item_id", "product_id")


add(
    "appended_sales_key",
    "W01 IO02",
    _appended_key,
    query(
        """SELECT row_number() OVER (ORDER BY order_id, order_item_id, product_id, seller_id,
                                           price, freight_value) AS sales_key,
               order_id, order_item_id, product_id FROM raw_items"""
    ),
)
