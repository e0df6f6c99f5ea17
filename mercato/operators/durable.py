"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor can read.

    It is named by ``spark.checkpoint.dir`` or set on the context. A local
    session without one uses a temporary folder; a cluster without one is an
    error, since executors share no local disk. A ``file:`` folder is taken at
    the cluster's word: it may be a mount that all nodes have.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), "mercato-tables")
    os.makedirs(folder, exist_ok=True)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark can reach; a missing one is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a checkpoint the table is columnar, so each reader fetches only
    the columns it needs.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class OwnedTables:
    """Tables of one owner in a folder of its own below the shared folder.

    ``drop`` removes a table that is no longer read, ``close`` all of them; both
    remove only what this owner has written. Frames that read a table become
    invalid with it.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.folder = new_path(spark, label)
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the table ``name``, once, and read it back."""
        if name in self._paths:
            raise ValueError(f"table {name} is written already")
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self._paths.pop(name))

    def close(self) -> None:
        self.drop(*list(self._paths))
        delete_path(self.spark, self.folder)

    def __enter__(self) -> OwnedTables:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
