"""Tables made of replaceable parts, whose current state is one manifest.

A manifest names, for every table, the folders of its parts and what is known
of them. Data is written first, to folders no manifest names yet; the manifest is
published last, under the next number, by one rename that fails where a rival
has published that number already. A reader takes one manifest and so sees one
state, also while a job writes or after it was lost between two tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.durable import delete_path

#: The partition column above a part's own: which write its folder comes from.
WRITE = "written_by"


#: Keys are digests written as text, which only a codec of letter frequencies makes shorter.
CODEC = "zstd"


class Conflict(RuntimeError):
    """Another job has published the version that this one was to publish."""


@dataclass(frozen=True)
class Table:
    """Parts by name: ``{"path": folder below the table's, ...}`` with whatever their owner notes."""

    schema: str
    parts: Mapping[str, Mapping[str, Any]]
    notes: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batches: tuple[str, ...] = ()
    tables: Mapping[str, Table] = field(default_factory=dict)

    def with_batch(self, batch: str, tables: Mapping[str, Table]) -> "Manifest":
        return Manifest(self.version + 1, (*self.batches, batch), {**self.tables, **tables})


class Snapshots:
    """The manifests of a folder and the tables they name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # Manifests

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/manifests/{name}")

    def versions(self) -> list[int]:
        """Numbers of the published manifests, rising."""
        place = self._hadoop.Path(f"{self.folder}/manifests")
        system = place.getFileSystem(self._conf)
        if not system.exists(place):
            return []
        names = (status.getPath().getName() for status in system.listStatus(place))
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A published state, the latest by default; without any, the empty one."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest()
        place = self._path(f"{version:010d}.json")
        stream = place.getFileSystem(self._conf).open(place)
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            data = json.loads(reader.readLine())
        finally:
            stream.close()
        tables = {name: Table(**table) for name, table in data["tables"].items()}
        return Manifest(data["version"], tuple(data["batches"]), tables)

    def publish(self, manifest: Manifest) -> Manifest:
        """Make a manifest the latest; a ``Conflict`` if its number is taken."""
        data = {
            "version": manifest.version,
            "batches": manifest.batches,
            "tables": {name: vars(table) for name, table in manifest.tables.items()},
        }
        temporary = self._path(f"_new-{uuid.uuid4().hex}")
        stream = temporary.getFileSystem(self._conf).create(temporary, False)
        try:
            stream.write((json.dumps(data, default=str) + "\n").encode())
        finally:
            stream.close()
        target = self._path(f"{manifest.version:010d}.json")
        options = getattr(self._hadoop, "Options$Rename")
        files = self._hadoop.FileContext.getFileContext(temporary.toUri(), self._conf)
        try:
            # Without the option to overwrite, a taken name is an error.
            files.rename(temporary, target, self.spark.sparkContext._gateway.new_array(options, 0))
        except Py4JJavaError as error:
            delete_path(self.spark, temporary.toString())
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {manifest.version} of {self.folder} is published already") from error
            raise
        return manifest

    # Tables

    def write(self, name: str, df: DataFrame, by: str) -> dict[str, dict]:
        """Write ``df`` with a folder for each value of the column ``by``; the parts, by folder name."""
        label = f"{WRITE}=w{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}/{label}"
        df.write.partitionBy(by).parquet(path, compression=CODEC)
        place = self._hadoop.Path(path)
        names = [s.getPath().getName() for s in place.getFileSystem(self._conf).listStatus(place)]
        values = {text: text.split("=", 1)[1] for text in names if text.startswith(f"{by}=")}
        return {value: {"path": f"{label}/{text}"} for text, value in values.items()}

    def write_whole(
        self,
        name: str,
        df: DataFrame,
        earlier: Table | None = None,
        sources: Mapping[str, DataFrame] | None = None,
        rule: str = "",
    ) -> Table:
        """Write ``df`` as a table of one part; the earlier table, if its rows are the same.

        Rows are compared by their number and the sum of their digests, which the
        write itself adds up. With the ``sources`` from which ``df`` follows by a ``rule``, these are compared
        first, by one scan each: where they are the same, ``df`` is not computed.
        """
        if sources is not None:
            made_from = {"rule": rule, **{source: self.state_of(rows) for source, rows in sources.items()}}
            if not (earlier and earlier.schema == df.schema.json() and earlier.notes.get("sources") == made_from):
                table = self.write_whole(name, df, earlier)
                earlier = Table(table.schema, table.parts, {**table.notes, "sources": made_from})
            return earlier
        label = f"{WRITE}=w{uuid.uuid4().hex}"
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        watched = df.observe(seen, *_state(df))
        watched.write.parquet(f"{self.folder}/{name}/{label}", compression=CODEC)
        found = seen.get
        state = {"rows": found["rows"], "digest": str(found["digest"])}
        table = Table(df.schema.json(), {"all": {"path": label, **state}})
        if earlier and earlier.schema == table.schema:
            old = earlier.parts.get("all", {})
            if {key: old.get(key) for key in state} == state:
                delete_path(self.spark, f"{self.folder}/{name}/{label}")
                return earlier
        return table

    def state_of(self, df: DataFrame) -> dict[str, Any]:
        """Number of rows and sum of their digests, by which ``write_whole`` compares tables."""
        (found,) = df.agg(*_state(df)).collect()
        return {"rows": found["rows"], "digest": str(found["digest"])}

    def read(self, manifest: Manifest, name: str) -> DataFrame:
        """A table as the manifest has it; folders of parts that a filter excludes are not read."""
        return self.read_parts(name, manifest.tables[name])

    def read_parts(self, name: str, table: Table, parts: Iterable[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        chosen = table.parts.values() if parts is None else [table.parts[part] for part in parts]
        base = f"{self.folder}/{name}"
        paths = [f"{base}/{part['path']}" for part in chosen]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def clean(self, keep: int = 1) -> list[str]:
        """Delete all manifests but the last ``keep``, and the parts that only those name."""
        versions = self.versions()
        gone = versions[: max(0, len(versions) - keep)]
        named = lambda numbers: {
            f"{self.folder}/{name}/{part['path']}"
            for number in numbers
            for name, table in self.manifest(number).tables.items()
            for part in table.parts.values()
        }
        unused = sorted(named(gone) - named(versions[len(gone) :]))
        for number in gone:
            delete_path(self.spark, self._path(f"{number:010d}.json").toString())
        for path in unused:
            delete_path(self.spark, path)
        return unused


def _state(df: DataFrame) -> list[Column]:
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns]
    digest = F.sum(F.xxhash64(*values, *(F.col(f"`{c}`").isNull() for c in df.columns)).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), digest.alias("digest")]


def updated(table: Table | None, schema: T.StructType, drop: Iterable[str], parts: Mapping[str, dict], **notes) -> Table:
    """A table with some parts gone and others put in."""
    kept = dict(table.parts) if table else {}
    for name in drop:
        kept.pop(name, None)
    old = Table(schema.json(), {}) if table is None else table
    return replace(old, parts={**kept, **parts}, notes={**old.notes, **notes})
