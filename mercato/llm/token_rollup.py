"""Token counts as rollups that signed changes maintain.

A change inserts a document under a tokenizer version, deletes it, or revises
its count. A batch of changes becomes a ledger of signed rows (documents and
tokens by document, source, language and tokenizer) and their signed sums by
source, language and tokenizer. Totals are the sums of all batches: they add
up, so no earlier batch is written again. The ledger is split by a hash of the document;
what a deletion or a revision takes away is looked up in the parts that the batch's own
documents fall into, and no others are read.

A batch becomes visible with a manifest that names its files and carries its id. Manifests
are numbered, and a number can be taken once: a second attempt under the same id, after a
lost driver or a redelivery, changes nothing, and a batch that meets a rival's commit
looks up again what it takes away, on top of that commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, only
from mercato.operators.durable import OwnedTables, delete_path
from mercato.sources.snapshots import Conflict, Manifest, Snapshots, updated

INSERT, DELETE, REVISE = "insert", "delete", "revise"
GROUP = ("source", "lang", "tokenizer")
KEY = ("doc_id", "tokenizer")
#: Parts of a new ledger; one that has batches keeps its own number.
PARTS = 64
_LEDGER = "doc_id long, source string, lang string, tokenizer string, documents long, tokens long, part int"
_TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


def change(operation: str, docs: DataFrame, tokenizer: str, tokens: Column | None = None, order: Column | None = None) -> DataFrame:
    """Changes of one kind for ``docs`` (doc_id, source, lang); a deletion needs no count."""
    return docs.select(
        F.lit(operation).alias("operation"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        (F.lit(None) if tokens is None else tokens).cast("bigint").alias("tokens"),
        (F.lit(0) if order is None else order).cast("bigint").alias("place"),
    )


class TokenRollup:
    """Rollups kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS) -> None:
        self.spark, self.parts = spark, parts
        self.folder = folder.rstrip("/")
        self.store = Snapshots(spark, self.folder)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(self.store.manifest().batches)

    def _read(self, base: Manifest, name: str, schema: str, parts: set[int] | None = None) -> DataFrame:
        table = base.tables.get(name)
        if table is None:
            return self.spark.createDataFrame([], schema)
        chosen = [key for key, part in table.parts.items() if parts is None or part["part"] in parts]
        return self.store.read_parts(name, table, chosen)

    def ledger(self, parts: set[int] | None = None, base: Manifest | None = None) -> DataFrame:
        """The signed rows, of all parts or of some."""
        return self._read(base or self.store.manifest(), "ledger", _LEDGER, parts)

    def current(self, parts: set[int] | None = None, base: Manifest | None = None) -> DataFrame:
        """What is counted now: a row for each document and tokenizer version."""
        return (
            self.ledger(parts, base)
            .groupBy("doc_id", *GROUP)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where("documents <> 0")
        )

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; empty groups are left out."""
        rows = self._read(self.store.manifest(), "totals", _TOTALS)
        return (
            rows.groupBy(*GROUP)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where("documents <> 0 OR tokens <> 0")
        )

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` under the id ``batch``; False if that id is committed already.

        Of several changes for one document and tokenizer the one with the
        highest ``place`` counts, of equal ones the greatest row. An insertion
        of a known document revises it, a revision of an unknown one inserts
        it, a deletion of an unknown one does nothing. A null count is 0; null
        sources and languages are groups of their own, a null id is an id.
        """
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"{batch!r} is no batch id")
        base = self.store.manifest()
        if batch in base.batches:
            return False
        table = base.tables.get("ledger")
        count = table.notes["count"] if table else self.parts
        last = F.max(F.struct("place", "operation", "source", "lang", "tokens")).alias("last")
        wanted = changes.groupBy(*KEY).agg(last).select(
            *(F.col(c).alias(f"new_{c}") for c in KEY),
            F.col("last.operation").alias("operation"),
            F.col("last.source").alias("new_source"),
            F.col("last.lang").alias("new_lang"),
            F.coalesce("last.tokens", F.lit(0)).alias("new_tokens"),
            F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("part"),
        )
        with OwnedTables(self.spark, "token-changes") as tables:
            # Written once, so that the changes are computed once, and again only read if a rival commits first.
            wanted = tables.write(wanted, "wanted")
            while True:
                attempt = self._attempt(base, batch, wanted, count)
                try:
                    done = self._commit(attempt, batch)
                except Conflict:
                    done = None
                if done:
                    return True
                self._discard(attempt, base)
                base = self.store.manifest()
                if done is False or batch in base.batches:
                    return False
                if "ledger" in base.tables and base.tables["ledger"].notes["count"] != count:
                    return self.apply(batch, changes)

    def _attempt(self, base: Manifest, batch: str, wanted: DataFrame, count: int) -> Manifest:
        """The state after the batch, with its files written."""
        # At most one row for each part.
        touched = {row["part"] for row in wanted.select("part").distinct().collect()}
        old = self.current(touched, base)
        on = old["doc_id"].eqNullSafe(wanted["new_doc_id"]) & old["tokenizer"].eqNullSafe(wanted["new_tokenizer"])
        # What is counted now and changes goes with a minus, what it becomes comes with a plus.
        taken = old.join(wanted.select("new_doc_id", "new_tokenizer"), on, "left_semi").select(
            "doc_id", *GROUP, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"),
            F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("part"),
        )
        put = wanted.where(F.col("operation") != DELETE).select(
            F.col("new_doc_id").alias("doc_id"),
            *(F.col(f"new_{c}").alias(c) for c in GROUP),
            F.lit(1).cast("long").alias("documents"),
            F.col("new_tokens").alias("tokens"),
            "part",
        )
        signed = taken.unionByName(put)
        written = self.store.write("ledger", signed.hint("rebalance", "part"), "part")
        if not written:
            return base.with_batch(batch, {})
        version = base.version + 1
        fresh = {f"{version}-{part}": {**info, "part": int(part)} for part, info in written.items()}
        ledger = updated(base.tables.get("ledger"), T.StructType.fromDDL(_LEDGER), (), fresh, count=count)
        sums = self.store.read_parts("ledger", ledger, fresh).groupBy(*GROUP).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        )
        (whole,) = self.store.write_whole("totals", sums).parts.values()
        totals = updated(base.tables.get("totals"), T.StructType.fromDDL(_TOTALS), (), {str(version): whole})
        return base.with_batch(batch, {"ledger": ledger, "totals": totals})

    def _commit(self, attempt: Manifest, batch: str) -> bool:
        """Publish the attempt; False if its batch is committed, a ``Conflict`` if another was meanwhile."""
        if batch in self.batches():
            return False
        self.store.publish(attempt)
        return True

    def _discard(self, attempt: Manifest, base: Manifest) -> None:
        """Remove the files only the attempt names."""
        for name, table in attempt.tables.items():
            kept = base.tables[name].parts if name in base.tables else {}
            for key in table.parts.keys() - kept.keys():
                delete_path(self.spark, f"{self.folder}/{name}/{table.parts[key]['path']}")


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``tokens``, the byte-pair tokens of the whole text; a null text has none."""
    source = only(docs, *keep, text)
    fields = [source.schema[name] for name in keep]

    def start():
        encoding = _encoding(ranks_path, pattern)

        def work(batch):
            texts = batch.column(len(keep)).to_pylist()
            return {name: batch.column(i) for i, name in enumerate(keep)} | {
                "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            }

        return work

    return arrow_map(source, start, T.StructType([*fields, T.StructField("tokens", T.LongType())]))


_ENCODINGS: dict = {}


def _encoding(ranks_path: str, pattern: str):
    """One encoding for each worker process, kept while the worker is reused."""
    if ranks_path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path]
