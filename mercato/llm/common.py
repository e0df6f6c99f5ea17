"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows a Python worker turns into Python objects at once.
ROWS_AT_ONCE = 256
#: Rows Spark sends a Python worker at once, and the setting for it.
ROWS_SENT, ROWS_SENT_KEY = 2 * ROWS_AT_ONCE, "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no other column can clash with an added one."""
    return df.select(*(F.col(f"`{name}`") for name in names))


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % divisor


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed, or at the same path, on every node.
    """
    environment = spark.sparkContext.environment
    place = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if place not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([place, *paths])


def small_batches(spark: SparkSession) -> None:
    """Let Spark send Python workers ROWS_SENT rows at once, for all later queries of the session.

    A batch of whole texts stands in memory several times, in the executor and in its worker, and
    Spark's 10,000 rows are 20 MB and more of each. A smaller setting stays.
    """
    rows = int(spark.conf.get(ROWS_SENT_KEY))
    if not 0 < rows <= ROWS_SENT:
        spark.conf.set(ROWS_SENT_KEY, str(ROWS_SENT))


#: What a worker process keeps from task to task, for the operator that ran last.
_kept: dict[str, Any] = {}
_ran_last: list[str] = []
_caches: list[Any] = []


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A store that stays in the worker process until another operator's task runs there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def worker_cache(maxsize: int) -> Callable:
    """``lru_cache`` that empties when another operator's task begins in the worker process."""

    def wrap(function: Callable) -> Callable:
        cached = functools.lru_cache(maxsize)(function)
        _caches.append(cached)
        return cached

    return wrap


def begin(operator: str) -> None:
    """Let go of what another operator has kept in this worker process, and give the memory back."""
    if _ran_last != [operator]:
        _kept.clear()
        for cached in _caches:
            cached.cache_clear()
        _ran_last[:] = [operator]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others have none
        if trim:
            trim(0)


def arrow_map(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], dict | None]],
    schema: StructType,
    rows: int = ROWS_AT_ONCE,
) -> DataFrame:
    """``mapInArrow`` over slices of few rows, so that memory does not follow the batch size.

    ``start()`` runs once in each task and returns the function that turns a
    slice into columns (lists or Arrow arrays) of ``schema``, or None for no
    rows.
    """
    importable(df.sparkSession)
    small_batches(df.sparkSession)
    arrow_schema = to_arrow_schema(schema)
    operator = f"{start.__module__}.{start.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        work = start()
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                columns = work(batch.slice(low, rows))
                if columns is None:
                    continue
                arrays = [
                    value
                    if isinstance(value, (pa.Array, pa.ChunkedArray))
                    else pa.array(value, type=arrow_schema.field(name).type)
                    for name, value in ((f.name, columns[f.name]) for f in arrow_schema)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return df.mapInArrow(run, schema)
