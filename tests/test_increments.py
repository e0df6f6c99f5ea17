"""Staging by months, manifests, and marts that follow them."""

import datetime as dt
import os

import market
import pytest

from mercato.plans import increments
from mercato.plans.increments import open_snapshot, publish_marts, refresh, stage_months
from mercato.plans.warehouse import Warehouse
from mercato.sources import snapshots
from mercato.sources.snapshots import Conflict, Manifest, Snapshots

RANGE = {"start": dt.date(2018, 1, 1), "end": dt.date(2018, 4, 1)}
JANUARY, FEBRUARY, MARCH = (dt.date(2018, month, 1) for month in (1, 2, 3))
TABLES = ("fct_sales", "dim_orders", "dim_customers", "dim_products", "dim_sellers")


def rows(frame) -> list[str]:
    return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))


def source(spark, until: dt.date | None = None, **changes) -> Warehouse:
    """The raw tables as they are before a day: orders, and items of those orders or of none."""
    tables = dict(market.BASE, **changes)
    if until:
        tables["orders"] = [o for o in tables["orders"] if o[3] is None or o[3].date() < until]
        known = {o[0] for o in market.BASE["orders"]} - {o[0] for o in tables["orders"]}
        tables["items"] = [i for i in tables["items"] if i[0] not in known]
    return Warehouse.from_raw(market.raw(spark, **tables), key="hash", **RANGE)


def held_against(spark, folder, whole: Warehouse) -> None:
    staged = open_snapshot(spark, folder, **RANGE)
    for name in TABLES:
        assert rows(getattr(staged, name).drop("purchase_month")) == rows(getattr(whole, name)), name


def test_months_one_at_a_time_equal_all_at_once(spark, tmp_path):
    by_month, at_once = str(tmp_path / "by-month"), str(tmp_path / "at-once")
    stage_months(source(spark, FEBRUARY), by_month, [JANUARY, None], "january")
    stage_months(source(spark, MARCH), by_month, [FEBRUARY], "february")
    manifest = stage_months(source(spark), by_month, [MARCH], "march")
    assert manifest.version == 3 and manifest.batches == ("january", "february", "march")
    stage_months(source(spark), at_once, [None, MARCH, JANUARY, FEBRUARY], "all")
    for folder in (by_month, at_once):
        held_against(spark, folder, source(spark))
    assert len(manifest.tables["fct_sales"].parts) == 4


def test_a_batch_is_applied_once_and_months_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "s")
    months = [JANUARY, FEBRUARY, MARCH, None]
    first = stage_months(source(spark), folder, months, "first")
    assert stage_months(source(spark), folder, months, "first") == first
    # An order moves from February to March, another goes.
    changed = [o for o in market.BASE["orders"] if o[0] not in ("o3", "o4")]
    changed.append(market.order("o3", "c3", "2018-03-09 08:00:00", arrived="2018-03-21 08:00:00"))
    items = [i for i in market.BASE["items"] if i[0] != "o4"]
    moved = source(spark, orders=changed, items=items)
    second = stage_months(moved, folder, [FEBRUARY, MARCH], "moved")
    held_against(spark, folder, moved)
    assert "2018-02-01" not in second.tables["fct_sales"].parts
    for name in ("dim_products", "dim_sellers"):
        assert second.tables[name] == first.tables[name]
    assert second.tables["dim_customers"] != first.tables["dim_customers"]
    january = "2018-01-01"
    assert second.tables["fct_sales"].parts[january] == first.tables["fct_sales"].parts[january]
    # The earlier state can still be read.
    assert rows(open_snapshot(spark, folder, 1).fct_sales.drop("purchase_month")) == rows(source(spark).fct_sales)
    gone = Snapshots(spark, folder).clean()
    assert gone and not any(os.path.exists(path) for path in gone)
    held_against(spark, folder, moved)
    assert Snapshots(spark, folder).versions() == [2]


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    stage_months(source(spark, MARCH), folder, [JANUARY, FEBRUARY, None], "first")
    before = {name: rows(getattr(open_snapshot(spark, folder), name)) for name in TABLES}
    write = Snapshots.write_whole

    def fails(self, name, *rest):
        if name == "dim_products":
            raise OSError("the executor is gone")
        return write(self, name, *rest)

    monkeypatch.setattr(Snapshots, "write_whole", fails)
    with pytest.raises(OSError, match="gone"):
        stage_months(source(spark), folder, [MARCH], "march")
    assert {name: rows(getattr(open_snapshot(spark, folder), name)) for name in TABLES} == before
    monkeypatch.undo()
    stage_months(source(spark), folder, [MARCH], "march")
    held_against(spark, folder, source(spark))


def test_rival_writers(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    base = store.manifest()
    assert base == Manifest()
    store.publish(base.with_batch("mine", {}))
    with pytest.raises(Conflict):
        store.publish(base.with_batch("theirs", {}))
    assert store.manifest().batches == ("mine",) and store.versions() == [1]
    left = os.listdir(tmp_path / "s" / "manifests")
    assert [name for name in left if not name.startswith(".")] == ["0000000001.json"]


def test_only_marts_whose_inputs_moved_are_rebuilt(spark, tmp_path):
    folder = str(tmp_path / "s")
    narrow = {"start": JANUARY, "end": dt.date(2018, 2, 28)}
    stage_months(source(spark, MARCH), folder, [JANUARY, FEBRUARY, None], "first")
    assert refresh(spark, folder, **narrow) == list(increments.INPUTS)
    assert refresh(spark, folder, **narrow) == []
    # March is outside the range of the growth marts.
    stage_months(source(spark), folder, [MARCH], "march")
    after = refresh(spark, folder, **narrow)
    assert after == [name for name in increments.INPUTS if name not in increments.RANGED]
    # Only sellers change: marts that don't read them stay.
    sellers = [*market.BASE["sellers"], ("s9", "x", "MG")]
    stage_months(source(spark, sellers=sellers), folder, [], "sellers")
    assert refresh(spark, folder, **narrow) == ["unit_economics", "strategic_risk_map"]
    assert refresh(spark, folder, start=JANUARY, end=MARCH) == list(increments.INPUTS)
    names = publish_marts(spark, folder, "kept_")
    assert len(names) == len(increments.INPUTS)
    whole = Warehouse.from_raw(market.raw(spark, sellers=sellers), key="hash", start=JANUARY, end=MARCH)
    for name in increments.INPUTS:
        assert rows(spark.table(f"kept_{name}")) == rows(getattr(whole, name)), name
    # What only earlier versions name goes with them.
    Snapshots(spark, folder).clean()
    folders = [d for d in (tmp_path / "s").iterdir() if d.name.startswith("mart_")]
    assert len(folders) == len(increments.INPUTS)
    assert all(len([d for d in f.iterdir() if d.name.startswith("written_by")]) == 1 for f in folders)


def test_date_ranges_prune_months(spark, tmp_path):
    folder = str(tmp_path / "s")
    stage_months(source(spark), folder, [JANUARY, FEBRUARY, MARCH, None], "all")
    growth = open_snapshot(spark, folder, start=FEBRUARY, end=MARCH).daily_volatility
    plan = growth._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan


def test_an_unchanged_dimension_is_not_built_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    first = stage_months(source(spark), folder, [JANUARY, None], "first")
    # A table that was written and found to be the same is deleted again.
    deleted = []
    monkeypatch.setattr(snapshots, "delete_path", lambda spark, path: deleted.append(path.split("/")[-2]))
    second = stage_months(source(spark), folder, [FEBRUARY, MARCH], "second")
    assert deleted == [] and all(second.tables[n] == first.tables[n] for n in ("dim_customers", "dim_products", "dim_sellers"))
    held_against(spark, folder, source(spark))
    sellers = [*market.BASE["sellers"], market.BASE["sellers"][0]]
    third = stage_months(source(spark, sellers=sellers), folder, [], "a row twice")
    # The raw rows moved, the dimension did not.
    assert deleted == ["dim_sellers"] and third.tables["dim_sellers"].parts == first.tables["dim_sellers"].parts


@pytest.mark.parametrize("few", [0, 100])
def test_months_of_few_and_of_many_orders_are_the_same(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(increments, "FEW_ORDERS", few)
    folder, warehouse = str(tmp_path / "s"), source(spark)
    assert (warehouse.of_orders(lambda orders: orders, few) is warehouse) == (few == 0)
    for months in ([JANUARY], [FEBRUARY, MARCH], [None], [JANUARY, MARCH]):
        stage_months(warehouse, folder, months, str(months))
    held_against(spark, folder, warehouse)


def test_the_key_is_no_part_of_the_shuffle(spark):
    seen = []
    warehouse = source(spark)
    fact = warehouse.fact_to_gather(lambda rows: seen.append(rows.columns) or rows)
    assert "sales_key" not in seen[0] and rows(fact) == rows(warehouse.fct_sales)
    assert fact.columns == warehouse.fct_sales.columns
