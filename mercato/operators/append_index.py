"""A global row number that grows with its table.

The rows are kept in slices, ordered by key from slice to slice and within each. The
manifest holds every slice's lowest key and number of rows, so a row's number is the
size of the slices before its own plus its place in it. New rows are sorted into
the slices they belong to, and only those are written anew; slices behind them
get other numbers by the manifest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.ranking import POSITION_BITS
from mercato.sources.snapshots import Manifest, Snapshots, Table, updated

SLICE_ROWS = 4_000_000
_TABLE = "index"


class AppendIndex:
    """Rows numbered 1..n in the order of ``keys``, NULLs last, in a folder of their own.

    Rows equal in all keys are numbered in the order in which they came. Values of
    ``keys`` must be types that JSON keeps exactly: texts, whole numbers, decimals, dates.
    """

    def __init__(
        self, spark: SparkSession, folder: str, keys: list[str], name: str, slice_rows: int = SLICE_ROWS
    ) -> None:
        self.store = Snapshots(spark, folder)
        self.spark, self.keys, self.name, self.slice_rows = spark, keys, name, slice_rows

    def _key(self) -> Column:
        """The key columns as one value in which NULLs come last."""
        return F.struct(
            *(
                part
                for i, key in enumerate(self.keys)
                for part in (F.col(key).isNull().alias(f"n{i}"), F.col(key).alias(f"k{i}"))
            )
        )

    def _slices(self, table: Table | None) -> list[str]:
        return list(table.notes["order"]) if table else []

    def append(self, df: DataFrame, batch: str) -> Manifest:
        """Number more rows; a batch that is in the manifest already does nothing.

        ``df`` should be a scan or a written table, whose row order is the same when
        a lost task is run again.
        """
        base = self.store.manifest()
        if batch in base.batches:
            return base
        table = base.tables.get(_TABLE)
        order = self._slices(table)
        columns = df.columns
        placed = df.withColumn("_slot", self._slot(df, table, order)).withColumns(
            {"_came": F.lit(1), "_tie": F.monotonically_increasing_id()}
        )
        # One row for each slice that gets rows.
        more = {row["_slot"]: row["n"] for row in placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = [order[slot] for slot in more if slot < len(order)]
        rows = placed
        if touched:
            slots = F.create_map(*(F.lit(v) for name in touched for v in (name, order.index(name))))
            kept = self.store.read_parts(_TABLE, table, touched)
            kept = kept.withColumns({"_slot": slots[F.col("slice")], "_came": F.lit(0), "_tie": F.col("_at")})
            rows = placed.unionByName(kept.select(*placed.columns))
        total = sum(more.values()) + sum(table.parts[name]["rows"] for name in touched)
        sort = ["_slot", *(F.col(key).asc_nulls_last() for key in self.keys), "_came", "_tie"]
        label = F.format_string(f"s{base.version + 1}-%d-%d", F.shiftrightunsigned("_at", POSITION_BITS), "_slot")
        sliced = (
            rows.repartitionByRange(max(1, -(-total // self.slice_rows)), *sort)
            .sortWithinPartitions(*sort)
            .withColumn("_at", F.monotonically_increasing_id())
            .withColumn("slice", label)
        )
        schema = T.StructType([*df.schema, T.StructField("_at", T.LongType()), T.StructField("slice", T.StringType())])
        parts = self.store.write(_TABLE, sliced.select(*columns, "_at", "_slot", "slice"), "slice")
        fresh = Table(T.StructType([*schema, T.StructField("_slot", T.IntegerType())]).json(), parts)
        found = (
            self.store.read_parts(_TABLE, fresh)
            .groupBy("slice", "_slot")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.min("_at").alias("first"),
                F.to_json(F.min(self._key()), {"ignoreNullFields": "false"}).alias("low"),
            )
            .collect()
        )
        gone = set(touched)
        places = [(slot, -1, name) for slot, name in enumerate(order) if name not in gone]
        for row in found:
            parts[row["slice"]] |= {"rows": row["rows"], "first": row["first"], "low": row["low"]}
            places.append((row["_slot"], row["first"], row["slice"]))
        names = [name for _, _, name in sorted(places)]
        return self.store.publish(
            base.with_batch(batch, {_TABLE: updated(table, schema, touched, parts, order=names)})
        )

    def _slot(self, df: DataFrame, table: Table | None, order: list[str]) -> Column:
        """The place of the slice a row belongs to: how many slices but the first begin at its key or below."""
        if len(order) < 2:
            return F.lit(0)
        key = T.StructType(
            [
                field
                for i, name in enumerate(self.keys)
                for field in (T.StructField(f"n{i}", T.BooleanType()), T.StructField(f"k{i}", df.schema[name].dataType))
            ]
        )
        lows = "[" + ",".join(table.parts[name]["low"] for name in order[1:]) + "]"
        borders = F.from_json(F.lit(lows), T.ArrayType(key))  # a constant: parsed once
        count = len(order) - 1
        steps = F.array(*(F.lit(1 << bit) for bit in range(count.bit_length() - 1, -1, -1)))
        mine = self._key()

        def farther(at: Column, step: Column) -> Column:
            beyond = at + step
            return F.when((beyond <= count) & (F.get(borders, beyond - 1) <= mine), beyond).otherwise(at)

        return F.reduce(steps, F.lit(0), farther)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows with their numbers, as of a version."""
        manifest = self.store.manifest(version)
        table = manifest.tables.get(_TABLE)
        if table is None:
            raise ValueError("nothing is indexed yet")
        starts, before = [], 0
        for name in self._slices(table):
            part = table.parts[name]
            starts.append((name, before - part["first"] + 1))
            before += part["rows"]
        # One row per slice, as the manifest holds them.
        small = self.spark.createDataFrame(starts, "slice string, _start long")
        rows = self.store.read(manifest, _TABLE).join(F.broadcast(small), "slice")
        return rows.withColumn(self.name, F.col("_start") + F.col("_at")).drop("slice", "_at", "_start")


