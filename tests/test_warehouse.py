"""What a warehouse writes, what it leaves, and its options."""

import datetime as dt
import os
from decimal import Decimal as D

import market
import pytest

from mercato.operators.durable import OwnedTables, shared_folder
from mercato.plans import staging
from mercato.plans.warehouse import Warehouse
from mercato.sources.retail import RANGE_END, RANGE_START, RetailTables
from mercato.sources.schemas import RAW_SCHEMAS
from mercato.sources.tables import read_table

RANGE = {"start": dt.date(2018, 1, 1), "end": dt.date(2018, 4, 1)}


def tables_of(spark) -> set[str]:
    folder = shared_folder(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def jobs_of(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_marts_over_staged_tables_start_no_job_and_write_nothing(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "staged")
    with Warehouse.from_raw(RetailTables(spark, sf_dir), start=RANGE_START, end=RANGE_END) as raw:
        raw.stage(folder)
    staged = Warehouse.from_staged(spark, folder, start=RANGE_START, end=RANGE_END)
    for name in ("dim_customers", "dim_orders", "dim_products", "dim_sellers", "fct_sales"):
        assert getattr(staged, name).columns  # reading a schema may start a job, once
    tables, jobs = tables_of(spark), jobs_of(spark)
    names = staged.publish("lazy_")
    assert tables_of(spark) == tables and jobs_of(spark) == jobs
    assert len(names) == 13 and spark.table("lazy_winback_segmentation").columns


def test_a_durable_warehouse_removes_what_it_wrote(spark):
    before = tables_of(spark)
    with Warehouse.from_raw(market.raw(spark), **RANGE) as warehouse:
        first = warehouse.publish("durable_")
        assert first and len(tables_of(spark) - before) == 1
        assert warehouse.strategic_risk_map.count() > 0
    assert tables_of(spark) == before


def test_the_fact_is_written_once_for_all_marts(spark, monkeypatch):
    written = []
    write = OwnedTables.write
    monkeypatch.setattr(OwnedTables, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    with Warehouse.from_raw(market.raw(spark), key="hash", **RANGE) as warehouse:
        for name in Warehouse.MARTS:
            getattr(warehouse, name)
    assert sorted(name.rsplit("-", 1)[0] for name in written) == [
        "categories", "fact", "journey", "keyed-fact", "ranked-rows"
    ]


def test_owned_tables(spark, tmp_path):
    frame = spark.range(5)
    with OwnedTables(spark, "owned") as tables:
        assert tables.write(frame, "a").count() == 5
        with pytest.raises(ValueError):
            tables.write(frame, "a")
        tables.drop("a")
        assert tables.write(frame, "a").count() == 5
    assert not any(name.startswith("owned-") for name in tables_of(spark))


def test_options_reach_the_marts(spark):
    raw = market.raw(spark)
    with Warehouse.from_raw(raw, lost_measure="price", minimum_reviews=10**6, **RANGE) as warehouse:
        lost = [m.canceled_revenue_loss for m in warehouse.executive_summary.collect()]
        assert max(lost) == D("30.00")
        assert {r.toxicity_ratio_pct for r in warehouse.product_quality_matrix.collect()} == {None}


def test_hash_key_is_unique_on_the_retail_tables(spark, sf_dir):
    columns = ("order_id", "order_item_id", "product_id", "seller_id")
    raw = RetailTables(spark, sf_dir)
    with Warehouse.from_raw(raw, key="hash", hash_columns=columns) as warehouse:
        keys = warehouse.fct_sales.select("sales_key")
        assert keys.distinct().count() == raw["items"].select(*columns).distinct().count()


def test_hash_key_tells_nulls_and_separators_apart(spark):
    rows = [("1-2", "3"), ("1", "2-3"), ("1", None), (None, "1"), ("1:1", ""), ("", "1:1"), ("~", ""), ("", "~"), (None, "")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert frame.select(staging.stable_key(("a", "b"))).distinct().count() == len(rows)


def test_wrong_lengths_do_not_stop_the_staging(spark):
    products = spark.createDataFrame([("p", "c", 1, 2000, 2000, 2000)], "product_id string, product_category_name string, product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int")
    names = spark.createDataFrame([("c", "d")], "product_category_name string, product_category_name_english string")
    assert staging.dim_products(products, names).first().volume_cm3 == 8 * 10**9


def test_csv_files_of_different_column_order_are_read_by_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,Recife,PE\n")
    (tmp_path / "b.csv").write_text("seller_id,seller_zip_code_prefix,seller_state,seller_city\ns2,1,PE,Recife\n")
    rows = read_table(spark, str(tmp_path), RAW_SCHEMAS["sellers"]).collect()
    assert sorted(map(tuple, rows)) == [("s1", "Recife", "PE"), ("s2", "Recife", "PE")]


def test_states_and_regions_by_hand(spark):
    """The 27 codes written out, apart from the table that engine and check SQL share."""
    from mercato.functions.geography import region_of, state_name

    text = """North: AC Acre, AM Amazonas, AP Amapá, PA Pará, RO Rondônia, RR Roraima, TO Tocantins
    Northeast: AL Alagoas, BA Bahia, CE Ceará, MA Maranhão, PB Paraíba, PE Pernambuco, PI Piauí, RN Rio Grande do Norte, SE Sergipe
    Central-West: DF Distrito Federal, GO Goiás, MS Mato Grosso do Sul, MT Mato Grosso
    Southeast: ES Espírito Santo, MG Minas Gerais, RJ Rio de Janeiro, SP São Paulo
    South: PR Paraná, RS Rio Grande do Sul, SC Santa Catarina"""
    want = {}
    for line in text.split("\n"):
        region, states = line.strip().split(": ")
        for state in states.split(", "):
            code, name = state.split(" ", 1)
            want[code] = (name, region)
    frame = spark.createDataFrame([(code,) for code in want], "code string")
    found = frame.select("code", state_name(frame["code"]).alias("n"), region_of(frame["code"]).alias("r")).collect()
    assert len(want) == 27 and {x.code: (x.n, x.r) for x in found} == want
