"""Reading, staging, publishing and exporting."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import market
from mercato.catalog import open_warehouse
from mercato.operators.durable import new_path
from mercato.plans.warehouse import Warehouse
from mercato.sources.schemas import RAW_SCHEMAS
from mercato.sources.tables import export_csv, read_raw, read_table, write_fact


def test_csv_in_another_column_order_with_quotes_and_blanks(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text(
        '"price","order_id","freight_value","note","order_item_id","product_id","seller_id"\n'
        '12.34,"a,1",0.10,"x",1,"",s1\n'
        '5.00,"b ""q""",,y,2,,s2\n'
    )
    rows = read_table(spark, str(path), RAW_SCHEMAS["items"]).orderBy("order_item_id").collect()
    assert rows[0].asDict() == {
        "order_id": "a,1", "order_item_id": 1, "product_id": "", "seller_id": "s1",
        "price": D("12.34"), "freight_value": D("0.10"),
    }
    assert rows[1].order_id == 'b "q"'
    assert rows[1].product_id is None and rows[1].freight_value is None


def test_csv_timestamps_and_errors(spark, tmp_path):
    path = tmp_path / "orders.csv"
    names = RAW_SCHEMAS["orders"].names
    path.write_text(",".join(names) + "\n" + "o,c,delivered,2018-01-02 03:04:05,,,,2018-01-09 00:00:00\n")
    row = read_table(spark, str(path), RAW_SCHEMAS["orders"]).first()
    assert row.order_purchase_timestamp == dt.datetime(2018, 1, 2, 3, 4, 5)
    assert row.order_delivered_customer_date is None
    short = tmp_path / "short.csv"
    short.write_text("order_id\no\n")
    with pytest.raises(ValueError, match="lacks"):
        read_table(spark, str(short), RAW_SCHEMAS["orders"])
    bad = tmp_path / "bad.csv"
    bad.write_text("order_id,review_score\no,five\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_table(spark, str(bad), RAW_SCHEMAS["reviews"]).collect()
    with pytest.raises(ValueError, match="format"):
        read_table(spark, str(bad), RAW_SCHEMAS["reviews"], "json")


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_raw_tables_round_trip_and_marts(spark, tmp_path, form):
    raw = market.raw(spark)
    paths = {name: str(tmp_path / name) for name in raw}
    for name, frame in raw.items():
        if form == "parquet":
            frame.write.parquet(paths[name])
        else:
            stamped = [
                F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp_ntz" else F.col(c)
                for c, t in frame.dtypes
            ]
            export_csv(frame.select(*stamped), paths[name])
    again = read_raw(spark, paths, form)
    for name, frame in raw.items():
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, frame.collect())), name
    options = {"start": dt.date(2018, 1, 1), "end": dt.date(2018, 4, 1)}
    assert (
        Warehouse.from_raw(again, **options).executive_summary.collect()
        == Warehouse.from_raw(raw, **options).executive_summary.collect()
    )


def test_files_of_a_folder_have_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "reviews"
    folder.mkdir()
    (folder / "a.csv").write_text("order_id,review_score,at\no1,5,2018-01-02 03:04:05\no2,five,2018-01-02 03:04:05\n")
    (folder / "b.csv").write_text(
        'extra,at,review_score,order_id\n"x,y",2018-01-02T03:04:05.250,4,o3\n,,,\nz,2018-01-02,1,o4\nz,2018-01-02T03:04:05,1\n'
        'z,2018-02-30T03:04:05,1,o5\n'
    )
    (folder / "c.csv").write_text("\ufefforder_id,at,review_score\n\"o \"\"6\",2018-01-02 03:04:05.5,2\n")
    (folder / "empty.csv").write_text("")
    (folder / "_SUCCESS").write_text("")
    schema = T.StructType([*RAW_SCHEMAS["reviews"], T.StructField("at", T.TimestampNTZType())])
    bad = str(tmp_path / "bad")
    kept = read_table(spark, str(folder), schema, quarantine=bad)
    at = dt.datetime(2018, 1, 2, 3, 4, 5)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [("o1", 5, at), ("o3", 4, at.replace(microsecond=250_000)), (None, None, None), ('o "6', 2, at.replace(microsecond=500_000))],
        key=repr,
    )
    rows = {(r.file.rsplit("/", 1)[1], r.record, r.reason) for r in spark.read.parquet(bad).collect()}
    assert rows == {
        ("a.csv", "o2,five,2018-01-02 03:04:05", "review_score is no int: five"),
        ("b.csv", "z,2018-01-02,1,o4", "at is no timestamp_ntz: 2018-01-02"),
        ("b.csv", "z,2018-01-02T03:04:05,1", "not as many values as columns"),
        ("b.csv", "z,2018-02-30T03:04:05,1,o5", "at is no timestamp_ntz: 2018-02-30T03:04:05"),
    }
    # Whatever columns a query reads, the same records count.
    assert kept.select("order_id").count() == kept.count() == 4
    with pytest.raises(Exception, match="malformed record"):
        read_table(spark, str(folder), schema).select("order_id").collect()


def test_headers_that_cannot_be_read_by(spark, tmp_path):
    twice = tmp_path / "twice.csv"
    twice.write_text("order_id,review_score,order_id\no,1,p\n")
    with pytest.raises(ValueError, match="twice"):
        read_table(spark, str(twice), RAW_SCHEMAS["reviews"])
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "nothing"), RAW_SCHEMAS["reviews"])
    blank = tmp_path / "blank"
    blank.mkdir()
    (blank / "a.csv").write_text("")
    assert read_table(spark, str(blank), RAW_SCHEMAS["reviews"]).count() == 0


def test_compressed_and_headed_only_files(spark, tmp_path):
    import gzip

    folder = tmp_path / "z"
    folder.mkdir()
    with gzip.open(folder / "a.csv.gz", "wt") as file:
        file.write("review_score,order_id\n3,o1\n")
    (folder / "b.csv").write_text("order_id,review_score\n")
    assert [tuple(r) for r in read_table(spark, str(folder), RAW_SCHEMAS["reviews"]).collect()] == [("o1", 3)]


def test_moments_survive_a_round_trip(spark, tmp_path):
    moments = [dt.datetime(2018, 1, 2, 3, 4, 5), dt.datetime(2018, 1, 2, 3, 4, 5, 678), None]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "id int, at timestamp_ntz")
    export_csv(frame, str(tmp_path / "m"))
    again = read_table(spark, str(tmp_path / "m"), frame.schema)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, frame.collect()))


def test_export_as_one_file(spark, tmp_path):
    frame = spark.range(100).repartition(5).selectExpr("id", "'' AS t").orderBy("id")
    for _ in range(2):  # the second time it takes the first file's place
        export_csv(frame, str(tmp_path / "one.csv"), single=True)
    lines = (tmp_path / "one.csv").read_text().splitlines()
    assert lines == ["id,t"] + [f'{i},""' for i in range(100)]
    assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["one.csv"]


def test_export_format(spark, tmp_path):
    frame = spark.createDataFrame(
        [("", D("1.50"), None), ("a,b", None, 'say "x"')], "c string, n decimal(9,2), t string"
    ).coalesce(1)
    export_csv(frame, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().splitlines() == ["c,n,t", '"",1.50,', '"a,b",,"say ""x"""']


def test_fact_is_written_by_month(spark, tmp_path):
    fact = Warehouse.from_raw(market.raw(spark)).fct_plain
    write_fact(fact, str(tmp_path / "fact"))
    folders = {name for name in os.listdir(tmp_path / "fact") if name.startswith("purchase_month")}
    assert folders == {
        "purchase_month=2018-01-01", "purchase_month=2018-02-01", "purchase_month=2018-03-01",
        "purchase_month=__HIVE_DEFAULT_PARTITION__",
    }
    assert spark.read.parquet(str(tmp_path / "fact")).count() == 8


def test_published_views(spark):
    warehouse = Warehouse.from_raw(
        market.raw(spark), start=dt.date(2018, 1, 1), end=dt.date(2018, 4, 1)
    )
    names = warehouse.publish("core_")
    assert len(names) == 13
    assert spark.sql("SELECT count(*) FROM core_fct_sales").first()[0] == 8
    joined = spark.sql(
        "SELECT g.sales_month FROM core_monthly_growth g JOIN core_executive_summary e USING (sales_month)"
    )
    assert joined.count() == 3


def test_invariants_of_the_retail_star(spark, sf_dir):
    warehouse = open_warehouse(spark, sf_dir)
    fact, raw = warehouse.fct_sales.cache(), warehouse.raw
    items = raw["items"].count()
    keys = fact.agg(F.min("sales_key"), F.max("sales_key"), F.countDistinct("sales_key")).first()
    assert tuple(keys) == (1, items, items)
    assert fact.where(F.col("price") + F.col("freight_value") != F.col("item_total_value")).count() == 0
    for name, key in (
        ("dim_customers", "customer_unique_id"), ("dim_orders", "order_id"),
        ("dim_products", "product_id"), ("dim_sellers", "seller_id"),
    ):
        frame = getattr(warehouse, name)
        assert frame.count() == frame.select(key).distinct().count(), name
    in_range = fact.where(F.col("purchase_date").between(warehouse.start, warehouse.end - dt.timedelta(1)))
    assert (
        warehouse.monthly_growth.agg(F.sum("current_month_revenue")).first()[0]
        == warehouse.daily_volatility.agg(F.sum("current_day_revenue")).first()[0]
        == in_range.agg(F.sum("item_total_value")).first()[0]
    )
    fact.unpersist()


def test_staging_folder_is_new_each_time(spark):
    assert new_path(spark, "x") != new_path(spark, "x")


def test_shuffle_partitions_grow_with_the_input(spark, sf_dir, monkeypatch):
    from mercato import session

    before = spark.conf.get(session.INITIAL_PARTITIONS, None)
    assert session.stored_bytes(spark, sf_dir) > 100_000
    session.tune(spark, sf_dir)
    assert spark.conf.get(session.INITIAL_PARTITIONS, None) == before
    monkeypatch.setattr(session, "stored_bytes", lambda *_: 10**12)
    session.tune(spark, sf_dir)
    assert int(spark.conf.get(session.INITIAL_PARTITIONS)) == 3_725
    monkeypatch.setattr(session, "stored_bytes", lambda *_: 100 * 10**12)
    session.tune(spark, sf_dir)
    assert int(spark.conf.get(session.INITIAL_PARTITIONS)) == 372_529
    spark.conf.unset(session.INITIAL_PARTITIONS)
    session.tune(spark, sf_dir, sf_dir, limit=50_000)
    assert int(spark.conf.get(session.INITIAL_PARTITIONS)) == 50_000
    spark.conf.unset(session.INITIAL_PARTITIONS)


def test_medium_inputs_get_fine_partitions(spark, monkeypatch):
    """Of 3 GB stored, a task gets no more than a thousandth."""
    from mercato import session

    before = spark.conf.get(session.INITIAL_PARTITIONS, None)
    monkeypatch.setattr(session, "stored_bytes", lambda *_: 3 * 10**9)
    session.tune(spark, "a table")
    assert int(spark.conf.get(session.INITIAL_PARTITIONS)) == 1000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"
    spark.conf.unset(session.INITIAL_PARTITIONS)
    if before:
        spark.conf.set(session.INITIAL_PARTITIONS, before)


def test_a_scan_task_reads_a_bounded_split(spark, tmp_path):
    """A large table's scan is cut by bytes, whatever the session has set before."""
    from mercato import session

    path = str(tmp_path / "t")
    spark.range(0, 9_000_000, 1, 1).selectExpr("id", "xxhash64(id) AS a").write.option(
        "parquet.block.size", 8 * 2**20
    ).parquet(path)
    assert session.stored_bytes(spark, path) > 80 * 2**20
    settings = {"spark.sql.files.maxPartitionBytes": "128MB", "spark.sql.files.minPartitionNum": "1"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    assert spark.read.parquet(path).rdd.getNumPartitions() == 1
    session.tune(spark)
    assert spark.read.parquet(path).rdd.getNumPartitions() >= 3
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    session.tune(spark)
