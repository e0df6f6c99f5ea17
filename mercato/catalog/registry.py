"""The list of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.plans.warehouse import Warehouse
from mercato.session import tune
from mercato.sources.retail import RANGE_END, RANGE_START, RetailTables


class RetailWarehouse(Warehouse):
    """A warehouse over the retail tables; ``raw`` holds the derived tables."""

    raw: RetailTables
    spark: SparkSession


def open_warehouse(spark: SparkSession, folder: str, **options) -> RetailWarehouse:
    sources = {f"{folder}/{source}.parquet" for source, _ in RetailTables.DERIVATIONS.values()}
    raw = RetailTables(tune(spark, *sources), folder)
    warehouse = RetailWarehouse.from_raw(raw, start=RANGE_START, end=RANGE_END, **options)
    warehouse.raw, warehouse.spark = raw, spark
    return warehouse


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[RetailWarehouse], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def add(
    name: str,
    covers: str,
    build: Callable[[RetailWarehouse], DataFrame],
    oracle: str | None,
) -> None:
    """Register a query; ``covers`` lists the inventory numbers it stands for."""
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Query(name, tuple(covers.split()), build, oracle)


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as doubles of at most six digits, dates and moments as text."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            if field.dataType.scale > 6:
                column = F.round(column, 6)
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_types(query.build(open_warehouse(spark, sf_dir)))

    run.__name__ = query.name
    return run
