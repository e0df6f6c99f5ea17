"""The row number that grows with its table."""

import random
from decimal import Decimal as D

import pytest

from mercato.operators.append_index import AppendIndex
from mercato.operators.ranking import ordered_index

SCHEMA = "order_id string, n int, price decimal(12,2), note string"
KEYS = ["order_id", "n", "price"]


def numbered(frame) -> list[tuple]:
    return sorted((r.key, r.order_id, r.n, r.price) for r in frame.collect())


def batch(seed: int, count: int, low: int, high: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(f"o{rng.randrange(low, high):05d}", rng.randrange(3), D(rng.randrange(4)), f"{seed}") for _ in range(count)]
    return rows + [(None, 1, D(1), "null"), (f"o{low:05d}", None, None, "null")]


def test_equals_one_full_run_in_any_order(spark, tmp_path):
    batches = [batch(1, 900, 0, 400), batch(2, 500, 300, 900), batch(3, 300, 0, 900), batch(4, 1, 5, 6), []]
    index = AppendIndex(spark, str(tmp_path / "i"), KEYS, "key", slice_rows=100)
    so_far = []
    for number, rows in enumerate(batches):
        so_far += rows
        index.append(spark.createDataFrame(rows, SCHEMA).repartition(3), f"b{number}")
        whole = ordered_index(spark.createDataFrame(so_far, SCHEMA).repartition(5), KEYS, "key")
        assert numbered(index.rows()) == numbered(whole)
        assert index.rows().columns == ["order_id", "n", "price", "note", "key"]
    version = index.store.manifest()
    assert index.append(spark.createDataFrame(batches[0], SCHEMA), "b0") == version
    assert len(index.rows(1).collect()) == len(batches[0])


def test_late_keys_leave_earlier_slices_alone(spark, tmp_path):
    index = AppendIndex(spark, str(tmp_path / "i"), ["k"], "key", slice_rows=50)
    index.append(spark.range(0, 2000, 2).selectExpr("id AS k"), "first")
    first = index.store.manifest().tables["index"]
    before = {r.k: r.key for r in index.rows().collect()}
    index.append(spark.range(2000, 2600).selectExpr("id AS k"), "later")
    second = index.store.manifest().tables["index"]
    kept = [name for name in first.notes["order"] if name in second.parts]
    # All slices but the last, which the new rows follow.
    assert kept == first.notes["order"][:-1] and len(kept) > 10
    assert all(second.parts[name] == first.parts[name] for name in kept)
    after = {r.k: r.key for r in index.rows().collect()}
    assert all(after[k] == key for k, key in before.items())
    assert sorted(after.values()) == list(range(1, 1601))
    # A row in the middle: its slice alone is written anew, those behind get other numbers.
    index.append(spark.createDataFrame([(999,)], "k long"), "middle")
    third = index.store.manifest().tables["index"]
    assert len(set(second.parts) - set(third.parts)) == 1
    last = {r.k: r.key for r in index.rows().collect()}
    assert last[998] == after[998] and last[999] == after[998] + 1 and last[1000] == after[1000] + 1


def test_nothing_indexed(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        AppendIndex(spark, str(tmp_path / "i"), ["k"], "key").rows()


def test_the_search_for_a_slice_parses_the_borders_once(spark, tmp_path):
    index = AppendIndex(spark, str(tmp_path / "i"), ["k"], "key", slice_rows=10)
    rows = spark.range(500).selectExpr("id AS k")
    table = index.append(rows, "first").tables["index"]
    slot = rows.select(index._slot(rows, table, table.notes["order"]).alias("s"))
    plan = slot._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
    slots = [r.s for r in slot.collect()]
    assert slots == sorted(slots) and slots[-1] == len(table.notes["order"]) - 1
