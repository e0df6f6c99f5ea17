"""Keys, values and copies that hold a third of all rows or more."""

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

import market
from mercato.operators.cumulative import running_total_desc
from mercato.operators.durable import shared_folder, written
from mercato.operators.ranking import first_rows, magnitude, ordered_index, percent_rank_desc
from mercato.plans import customers, staging


def test_ordered_index_with_a_hot_order_and_copies(spark):
    rng = random.Random(5)
    rows = [("hot", i, f"p{i % 7}") for i in range(3000)]
    rows += [(f"o{rng.randrange(900)}", rng.randrange(9), "p") for _ in range(3000)]
    rows += [("copy", 1, "same")] * 3000 + [(None, 1, "p")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "order_id string, n int, product_id string").repartition(7)
    indexed = ordered_index(frame, ["order_id", "n", "product_id"], "key").collect()
    last = ("~" * 9, 0, "")
    expected = sorted(rows, key=lambda r: r if r[0] else last)
    assert [tuple(r)[:3] for r in sorted(indexed, key=lambda r: r.key)] == expected
    assert sorted(r.key for r in indexed) == list(range(1, len(rows) + 1))


def test_copies_are_spread_over_slices(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("same").alias("order_id"))
    order = [F.col("order_id"), F.col("_place")]
    spread = (
        rows.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(8, *order)
        .groupBy(F.spark_partition_id().alias("slice"))
        .count()
        .collect()
    )
    assert len(spread) == 8
    assert max(row["count"] for row in spread) < 20_000 / 3


def test_percent_rank_with_a_hot_group_and_hot_values(spark):
    rng = random.Random(7)
    rows = [("hot", D(rng.randrange(1, 5_000_000)) / 100) for _ in range(2000)]
    rows += [("hot", D("10.00"))] * 2000
    rows += [(f"g{i % 40}", D(rng.randrange(-200, 200)) / 100) for i in range(1000)]
    rows += [("single", D("3.00")), (None, D("2.00")), (None, D("1.00")), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v decimal(22,2)").repartition(5)
    ranked = percent_rank_desc(frame, "g", "v", "rank").collect()
    groups = defaultdict(list)
    for group, value in rows:
        groups[group].append(value)
    expected = Counter()
    for group, values in groups.items():
        for value in values:
            above = sum(1 for other in values if other is not None and value is not None and other > value)
            expected[group, value, above / (len(values) - 1) if len(values) > 1 else 0.0] += 1
    assert Counter((r.g, r.v, r.rank) for r in ranked) == expected


def test_magnitude_never_falls(spark):
    amounts = sorted({D(n) / 100 for n in range(-3000, 3000, 7)} | {D(10) ** p for p in range(1, 15)})
    frame = spark.createDataFrame([(a,) for a in amounts], "v decimal(22,2)").coalesce(1)
    steps = [r.s for r in frame.orderBy("v").select(magnitude(F.col("v")).alias("s")).collect()]
    assert steps == sorted(steps)


def test_first_rows_of_a_hot_customer_are_cut_before_the_shuffle(spark):
    frame = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("who"), "id"
    )
    kept = first_rows(frame, "who", [F.col("id").desc()], 2, "n")
    hot = kept.where(F.col("who") == "hot").orderBy("n").collect()
    assert [row.id for row in hot] == [29_997, 29_994]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert plan.rindex("WindowGroupLimit") > shuffle > plan.index("WindowGroupLimit")


@pytest.fixture
def small_skew_limits(spark):
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_a_hot_order_is_split_in_the_fact_join(spark, small_skew_limits):
    raw = market.raw(spark)
    items = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, "o1").otherwise(F.concat(F.lit("x"), "id")).alias("order_id"),
        F.col("id").cast("int").alias("order_item_id"),
        F.concat(F.lit("p"), (F.col("id") % 977).cast("string")).alias("product_id"),
        F.lit("s1").alias("seller_id"),
        F.lit(D("1.00")).cast("decimal(12,2)").alias("price"),
        F.lit(D("0.50")).cast("decimal(12,2)").alias("freight_value"),
    )
    fact = staging.fct_sales(items, raw["orders"], raw["customers"], key=None)
    assert fact.where(F.col("customer_unique_id") == "u1").count() == 30_000
    fact.collect()
    assert "skew=true" in fact._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default):
            return self.folder or default

    class Cluster:
        sparkContext = type(
            "Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None}
        )()

        def __init__(self, folder=None):
            self.conf = Conf(folder)

    with pytest.raises(RuntimeError):
        shared_folder(Cluster())
    assert shared_folder(Cluster("/shared/tables")) == "/shared/tables"


def test_journey_states_with_a_hot_customer_and_a_hot_order(spark):
    """Half of all rows are one customer's, a sixth one order's; NULLs and orders of several days too."""
    rng = random.Random(11)
    day = lambda n: None if n is None else dt.date(2018, 1, 1) + dt.timedelta(n)
    rows = [("hot", f"o{i // 3}", i % 3, day(rng.randrange(3, 300)), D(i % 90)) for i in range(4000)]
    rows += [("hot", "big", i, day(2), D(1)) for i in range(1300)]
    for i in range(2000):
        n = rng.choice([None, *range(5)])
        rows.append((f"c{i % 400}", rng.choice([None, f"p{rng.randrange(3)}"]), rng.randrange(3), day(n), D("0.50")))
    rows += [(None, "x", 1, day(1), D(5)), ("once", "y", 1, day(9), D(7)), ("undated", "z", 1, None, D(7))]
    rng.shuffle(rows)
    schema = "customer_unique_id string, order_id string, item_sequence_number int, purchase_date date, item_total_value decimal(12,2)"
    fact = spark.createDataFrame(rows, schema).repartition(7)
    found = {r.customer_unique_id: tuple(r)[1:] for r in customers.customer_states(fact).collect()}
    buckets = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            buckets[row[0]].append(row)
    last = (True, "")
    want = {}
    for name, own in buckets.items():
        own.sort(key=lambda r: ((r[3] is None, r[3] or day(0)), (False, r[1]) if r[1] is not None else last, r[2]))
        orders = {r[1] for r in own if r[1] is not None}
        second = own[1][3] if len(own) > 1 else None
        want[name] = (len(orders), sum(r[4] for r in own), own[0][1], second)
    assert found == want
    # No window over a customer's rows, and no list of them.
    plan = customers.customer_states(fact)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_running_total_of_many_values_and_large_ties(spark):
    rng = random.Random(13)
    values = [D(rng.randrange(-500, 10**8)) / 100 for _ in range(100_000)]
    values += [D("77.77")] * 20_000 + [None] * 3 + [D("0.00")] * 50 + [D("-3.00")] * 9 + [D("9999999999999.99")]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v decimal(22,2)").repartition(6)
    totalled = running_total_desc(written(frame, "values"), "v", "total")
    plan = totalled._jdf.queryExecution().executedPlan().toString()
    # No window is fed by a single partition.
    feeds = [chunk.split("Exchange ", 1)[1].split("\n")[0] for chunk in plan.split("Window ")[1:]]
    assert feeds and all(feed.startswith("hashpartitioning") for feed in feeds)
    sums, running = {}, D(0)
    for value in sorted((v for v in values if v is not None), reverse=True):
        running += value
        sums[value] = running
    assert all(r.total == sums.get(r.v) for r in totalled.collect())
