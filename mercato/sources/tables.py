"""Reading raw tables, staging, publishing views and exporting marts."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import month_of
from mercato.operators.durable import delete_path
from mercato.sources.schemas import RAW_SCHEMAS


# How CSV files are written and read: moments with a blank, whole seconds and fractions.
MOMENT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
QUARANTINE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("file", "record", "reason")]
)
_MALFORMED, _FILE, _REASON = "_load_malformed", "_load_file", "_load_reason"
_MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    form: str = "csv",
    quarantine: str | None = None,
) -> DataFrame:
    """Read one table with a given schema from CSV or Parquet.

    Each CSV file is read by its own header: files of a folder may have their
    columns in different orders, and more columns than the schema. Nothing between
    two commas is NULL, ``""`` is the empty string. Moments may have a blank or
    a ``T`` between day and time.

    A bad record has too few or too many values, or a value that doesn't fit its
    column's type. With ``quarantine`` such records are appended to the table in
    that folder (``file``, ``record``, ``reason``) and left out; kept and
    quarantined records add up to all. Without, reading the first one is an error.
    """
    if form == "parquet":
        return spark.read.schema(schema).parquet(path)
    if form != "csv":
        raise ValueError(f"unknown table format: {form}")
    records = csv_records(spark, path, schema)
    if quarantine is None:
        stop = F.concat(F.lit("malformed record of "), _FILE, F.lit(": "), _REASON)
        strict = F.when(F.col(_REASON).isNull(), F.lit(True)).otherwise(F.raise_error(stop))
        return records.where(strict).select(*schema.names)
    quarantined(records).write.mode("append").parquet(quarantine)
    return records.where(F.col(_REASON).isNull()).select(*schema.names)


def csv_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All records of the CSV files, typed, with file, text if malformed, and what is wrong with them.

    Files with the same header are read together, so the plan grows with the
    number of different headers only.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in csv_headers(spark, path):
        lacking = [name for name in schema.names if name not in names]
        if lacking:
            raise ValueError(f"{file} lacks the columns {lacking}")
        if len(set(names)) < len(names):
            raise ValueError(f"{file} has a column twice: {names}")
        groups.setdefault(names, []).append(file)
    if not groups:
        return spark.createDataFrame([], T.StructType([*schema, *_LOADED]))
    parts = [_records(spark, files, names, schema) for names, files in groups.items()]
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    return records


_LOADED = [T.StructField(name, T.StringType()) for name in (_FILE, _MALFORMED, _REASON)]


def _records(
    spark: SparkSession, files: list[str], names: tuple[str, ...], schema: T.StructType
) -> DataFrame:
    texts = T.StructType([T.StructField(name, T.StringType()) for name in (*names, _MALFORMED)])
    raw = (
        spark.read.schema(texts)
        .options(**CSV_OPTIONS, mode="PERMISSIVE", multiLine=False, enforceSchema=True)
        .options(nullValue="\\N", emptyValue="", columnNameOfCorruptRecord=_MALFORMED)
        .options(columnPruning=False)  # else a record is only checked as far as it is read
        .csv(files)
        .withColumn(_FILE, F.input_file_name())
    )
    typed, wrong = [], [F.when(F.col(_MALFORMED).isNotNull(), F.lit("not as many values as columns"))]
    for field in schema:
        text = F.col(f"`{field.name}`")
        value = _typed(text, field.dataType)
        typed.append(value.alias(field.name))
        says = F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text)
        wrong.append(F.when(text.isNotNull() & value.isNull(), says))
    shown = F.coalesce(_MALFORMED, F.to_csv(F.struct(*(F.col(f"`{name}`") for name in names))))
    reason = F.coalesce(*wrong)
    return raw.select(
        *typed, _FILE, F.when(reason.isNotNull(), shown).alias(_MALFORMED), reason.alias(_REASON)
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.when(text.rlike(_MOMENT), text)
    return text.try_cast(kind)


def quarantined(records: DataFrame) -> DataFrame:
    """The bad ones among ``csv_records``."""
    bad = records.where(F.col(_REASON).isNotNull())
    return bad.select(
        F.col(_FILE).alias("file"), F.col(_MALFORMED).alias("record"), F.col(_REASON).alias("reason")
    )


def csv_headers(spark: SparkSession, path: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Each CSV file below a path (or pattern) and the names in its first line; empty files are left out.

    Only the first line of a file is read, several files at a time.
    """
    files = sorted(_files(spark, path))
    with ThreadPoolExecutor(HEADER_READERS) as readers:
        for file, line in zip(files, readers.map(lambda file: _first_line(spark, file), files)):
            if line is not None:
                yield file, tuple(next(csv.reader([line.removeprefix("\ufeff")])))


HEADER_READERS = 16


def _files(spark: SparkSession, path: str) -> Iterator[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(place)
    if not found:
        raise FileNotFoundError(path)
    for status in found:
        below = system.listFiles(status.getPath(), True)
        while below.hasNext():
            file = below.next()
            inner = file.getPath().toString().removeprefix(status.getPath().toString())
            hidden = any(part[0] in "_." for part in inner.split("/") if part)
            if not hidden and file.getLen():
                yield file.getPath().toString()


def _first_line(spark: SparkSession, file: str) -> str | None:
    jvm = spark._jvm
    conf, place = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(file)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        plain = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def read_raw(
    spark: SparkSession,
    paths: Mapping[str, str],
    form: str = "csv",
    quarantine: str | None = None,
) -> dict[str, DataFrame]:
    """The eight raw tables from ``{table name: path}``.

    With ``quarantine`` bad CSV records go to a table for each raw table below that folder.
    """
    return {
        name: read_table(spark, paths[name], schema, form, quarantine and f"{quarantine}/{name}")
        for name, schema in RAW_SCHEMAS.items()
    }


def write_dimension(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_fact(fct: DataFrame, path: str) -> None:
    """Write the fact with a folder per month of purchase.

    The rebalance hint gathers the rows of a month into few files, and lets
    AQE split a month that holds most rows over several tasks.
    """
    (
        fct.withColumn("purchase_month", month_of(F.col("purchase_date")))
        .hint("rebalance", "purchase_month")
        .write.mode("overwrite")
        .partitionBy("purchase_month")
        .parquet(path)
    )


def write_orders(orders: DataFrame, path: str) -> None:
    """Write the orders with a folder per month of purchase, sorted by status within a file.

    A date range then reads its months only, and a status the row groups that hold it.
    """
    month = month_of(F.col("order_purchase_timestamp").cast("date"))
    (
        orders.withColumn("purchase_month", month)
        .hint("rebalance", "purchase_month")
        .sortWithinPartitions("purchase_month", "order_status")
        .write.mode("overwrite")
        .partitionBy("purchase_month")
        .parquet(path)
    )


def publish(frames: Mapping[str, DataFrame], prefix: str = "") -> list[str]:
    """Make DataFrames readable by name from ``spark.sql``."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]


def export_csv(mart: DataFrame, path: str, single: bool = False) -> None:
    """Write a mart as CSV with a header, as a folder of files or as one file.

    An empty string is written as ``""`` and a missing value as nothing, so
    the two stay apart. ``single`` gathers all rows in one task: it is for
    reports, whose rows are months, categories or lanes.
    """
    options = {**CSV_OPTIONS, "emptyValue": '""', "nullValue": "", "timestampNTZFormat": MOMENT_FORMAT}
    if not single:
        mart.write.mode("overwrite").options(**options).csv(path)
        return
    spark = mart.sparkSession
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    mart.coalesce(1).write.options(**options).csv(parts)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    (file,) = _files(spark, parts)
    system.delete(place, True)
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(file), place):
        raise OSError(f"{path} can't be written")
    delete_path(spark, parts)
