"""Passages that stand more than once in a corpus, found by suffix arrays and cut out.

Every byte goes that a string of ``width`` bytes covers which also begins at another
place, in the same text or in any other. Strings are judged on the input, not
on what is left of it.

1. Texts with the same bytes become one row with its number of copies, in a table
   whose buckets the later joins need not shuffle. A copied text goes whole.
2. Each string of ``width`` bytes has an anchor: the window of ``anchor`` bytes in it
   with the least fingerprint, the first of equals. Equal strings have equal
   anchors, wherever they are. Neighbouring strings share theirs, so a text falls
   into stretches of strings with one anchor, and each string is in one stretch;
   equal anchors less than ``CLOSE`` places apart, as in a text that repeats a word,
   make one stretch. Strings can only be equal if their anchors are.
3. Stretches whose anchor occurs once can't hold a repeat and go. Equal
   stretches become one piece with its number of copies; what follows works on
   pieces, so that a passage in a third of all documents is a few rows.
4. The pieces of an anchor meet in a shard; one that has copies is put there
   twice. Shards get suffix arrays by induced sorting and permuted common
   prefixes (``induced_sorting``): a place whose suffix has ``width`` bytes in common
   with a neighbour's in the array begins a repeated string.
5. An anchor shared by more than ``SHARD_PIECES`` different pieces (the edges of
   a passage that very many documents quote, say) would make a shard without
   bound. Its strings are told apart by a hash of 128 bits each, which Spark counts
   with partial sums; as exact, but for a collision of hashes, and for any number.
6. The places go back to the stretches and the texts they were found in.

Nothing is collected: the largest group a task holds is a text's own places, or a
shard of ``SHARD_PIECES`` pieces of at most ``2 * width`` bytes.

Defined results: a null text has no row in ``distinct_texts``; an empty one, and one
of fewer than ``width`` bytes, loses nothing. Ties don't occur: all copies go, none
is kept. A character that is cut apart leaves bytes that are no UTF-8, so what is
kept is binary. Only the text column is read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mercato.llm.common import arrow_map, begin, importable
from mercato.llm.induced_sorting import repeated_places
from mercato.operators.durable import OwnedTables

U64 = np.uint64
#: Equal anchors at fewer places than these from the first one share its stretch.
CLOSE = 32
#: More different pieces than these of one anchor are compared by hashes.
SHARD_PIECES = 16
#: Bytes of the shards that a task sorts at once, and into how many strings they are dealt.
SORT_BYTES, STRINGS = 1_200_000, 256
#: Bytes fingerprinted at once; a longer text is taken in overlapping parts.
PART_BYTES = 1_000_000
#: Bytes of text for each bucket, at most, unless the session asks for more buckets.
BUCKET_BYTES = 256 * 1024 * 1024

_PLACE_BITS = 24
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class RepeatRule:
    width: int = 400
    anchor: int = 128


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = _mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, U64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def fingerprints(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for each window of ``width`` bytes, equal for equal windows."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_CODES[data] * _powers(_BASE, len(data)), out=sums[1:])
    windows = sums[width:] - sums[:-width]
    return _mix(windows * _powers(_INVERSE, len(windows)))


def _least_in(values: np.ndarray, count: int) -> np.ndarray:
    """The least of each ``count`` neighbours."""
    span = 1
    while 2 * span <= count:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (count - span)], values[count - span :]) if count > span else values


def _parts(texts: list[bytes], rule: RepeatRule) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, place, bytes) of about PART_BYTES; each string of a text is in one part."""
    batch, size = [], 0
    for number, text in enumerate(texts):
        for place in range(0, max(len(text) - rule.width + 1, 0), PART_BYTES):
            part = text[place : place + PART_BYTES + rule.width - 1]
            if batch and size + len(part) > PART_BYTES:
                yield batch
                batch, size = [], 0
            batch.append((number, place, part))
            size += len(part)
    if batch:
        yield batch


def stretches(texts: list[bytes], rule: RepeatRule) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of strings with one anchor: text, first place, number of places, number of
    equal anchors, the anchor's fingerprint, hash of the bytes.
    """
    for parts in _parts(texts, rule):
        data = np.frombuffer(b"".join(part for _, _, part in parts), np.uint8)
        prints = fingerprints(data, rule.anchor)
        ranked = (prints >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | np.arange(len(prints), dtype=U64)
        anchor = (_least_in(ranked, rule.width - rule.anchor + 1) & U64(2**_PLACE_BITS - 1)).astype(np.int64)
        sizes = np.array([len(part) for _, _, part in parts])
        offsets = np.cumsum(sizes) - sizes
        counts = sizes - rule.width + 1
        # Strings that lie across two parts don't count.
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(offsets, counts) + within
        anchors = anchor[starts]
        moved = within == 0
        moved[1:] |= anchors[1:] != anchors[:-1]
        at = np.flatnonzero(moved)
        fp = prints[anchors[at]]
        other = within[at] == 0
        other[1:] |= fp[1:] != fp[:-1]
        away = (anchors[at] - np.maximum.accumulate(np.where(other, anchors[at], 0))) // CLOSE
        other[1:] |= away[1:] != away[:-1]
        chosen = np.flatnonzero(other)
        first, fp, times = at[chosen], fp[chosen], np.diff(chosen, append=len(at))
        number = np.diff(first, append=len(starts))
        begins = starts[first]
        owner = np.searchsorted(offsets, begins, side="right") - 1
        raw = data.tobytes()
        hashes = b"".join(
            hashlib.blake2b(raw[at : at + n + rule.width - 1], digest_size=8).digest()
            for at, n in zip(begins.tolist(), number.tolist())
        )
        yield (
            np.array([part[0] for part in parts])[owner],
            begins - offsets[owner] + np.array([part[1] for part in parts])[owner],
            number,
            times,
            fp.view(np.int64),
            np.frombuffer(hashes, np.int64),
        )


def text_id(text: str | Column) -> Column:
    """128 bits of a text's digest; equal for equal bytes, null for a null text."""
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.unhex(F.substring(F.sha2(column.cast("binary"), 256), 1, 32))


def _ranges(places: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(places) > 1)
    return [
        {"first": int(a), "last": int(b)}
        for a, b in zip(places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)])
    ]


def _array_repeats(pieces: DataFrame, rule: RepeatRule) -> DataFrame:
    """Repeated places of pieces that are sorted by fingerprint within partitions."""
    schema = StructType.fromDDL("fp long, piece long, ranges array<struct<first:int,last:int>>")
    arrow_schema = to_arrow_schema(schema)

    def sort(groups: list[list[tuple]]) -> pa.RecordBatch:
        # Groups are dealt into strings of like length, since a step of the sort takes one place of each.
        sizes = [sum(len(row[3]) * min(row[2], 2) for row in group) for group in groups]
        room = max(max(sizes), sum(sizes) // STRINGS)
        strings, held, size = [], [], room
        for group, more in zip(groups, sizes):
            if size + more > room:
                strings.append([])
                held.append([])
                size = 0
            size += more
            for row in group:
                held[-1] += [row, None][: min(row[2], 2)]
                strings[-1] += [row[3]] * min(row[2], 2)
        rows = []
        for these, places in zip(held, repeated_places(strings, rule.width)):
            rows += [
                {"fp": row[0], "piece": row[1], "ranges": _ranges(found)}
                for row, found in zip(these, places)
                if row and len(found)
            ]
        return pa.RecordBatch.from_pylist(rows, arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix arrays")
        groups, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[0] != last:
                    if size >= SORT_BYTES:
                        yield sort(groups)
                        groups, size = [], 0
                    groups.append([])
                    last = row[0]
                groups[-1].append(row)
                size += len(row[3]) * min(row[2], 2)
        if groups:
            yield sort(groups)

    return pieces.select("fp", "piece", "copies", "bytes").mapInArrow(run, schema)


def _hashed_strings(pieces: DataFrame, rule: RepeatRule) -> DataFrame:
    """Each string of the pieces by a hash of its own (a, b)."""
    schema = StructType.fromDDL("a long, b long, fp long, piece long, place int, copies long")

    def start():
        def work(batch):
            names = batch.schema.names
            fp, piece, copies, content = (batch.column(names.index(c)).to_pylist() for c in ("fp", "piece", "copies", "bytes"))
            counts = [len(raw) - rule.width + 1 for raw in content]
            hashes = b"".join(
                hashlib.blake2b(raw[at : at + rule.width], digest_size=16).digest()
                for raw, count in zip(content, counts)
                for at in range(count)
            )
            both = np.frombuffer(hashes, np.int64).reshape(-1, 2)
            return {
                "a": pa.array(both[:, 0]),
                "b": pa.array(both[:, 1]),
                "fp": np.repeat(np.array(fp, np.int64), counts),
                "piece": np.repeat(np.array(piece, np.int64), counts),
                "place": np.concatenate([np.arange(count, dtype=np.int32) for count in counts]),
                "copies": np.repeat(np.array(copies, np.int64), counts),
            }

        return work

    return arrow_map(pieces, start, schema)


def _more_than(count: int, rows: DataFrame, *key: str, weight: str | None = None) -> DataFrame:
    """Keys of more than ``count`` rows, or of rows that weigh more together."""
    total = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.groupBy(*key).agg(total.alias("n")).where(F.col("n") > count).select(*key)


class _Texts:
    """The distinct texts, in buckets by id, so that joins by id leave them where they are."""

    def __init__(self, docs: DataFrame, text: str, folder: str) -> None:
        self.spark = spark = docs.sparkSession
        rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = least * max(1, -(-size // (least * BUCKET_BYTES)))
        self.path = f"{folder}/texts"
        self.name = f"distinct_texts_{uuid.uuid4().hex}"
        one = rows.groupBy(text_id("text").alias("text_id")).agg(
            F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
        )
        one.write.bucketBy(buckets, "text_id").option("path", self.path).format("parquet").saveAsTable(self.name)
        self.rows = spark.table(self.name)


def distinct_texts(docs: DataFrame, text: str = "text", rule: RepeatRule = RepeatRule()) -> DataFrame:
    """``text_id``, ``n_bytes``, ``spans`` (begin and end of each run of bytes that goes) and ``kept`` of each distinct text.

    Reads tables written to the shared folder, which stay there.
    """
    spark = docs.sparkSession
    importable(spark)
    tables = OwnedTables(spark, "suffix-dedup")
    texts = _Texts(docs, text, tables.folder).rows

    def cut():
        def work(batch):
            ids, contents = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            found = list(stretches(contents, rule))
            if not found:
                return None
            owner, place, places, times, fp, piece = (np.concatenate(column) for column in zip(*found))
            return {
                "text_id": ids.take(pa.array(owner)),
                "place": pa.array(place, pa.int32()),
                "places": pa.array(places, pa.int32()),
                "times": pa.array(times, pa.int32()),
                "fp": pa.array(fp),
                "piece": pa.array(piece),
            }

        return work

    long_enough = texts.where(F.octet_length("text") >= rule.width).select("text_id", "text")
    schema = StructType.fromDDL("text_id binary, place int, places int, times int, fp long, piece long")
    # Counts are written before rows meet them: a join of two written tables splits a hot key over tasks.
    anchored = tables.write(arrow_map(long_enough, cut, schema), "anchored")
    shared = tables.write(_more_than(1, anchored, "fp", weight="times"), "shared")
    candidates = tables.write(anchored.drop("times").join(shared, "fp"), "candidates")
    tables.drop("anchored", "shared")

    # One place for each different piece, to fetch its bytes from.
    pieces = tables.write(
        candidates.groupBy("fp", "piece").agg(
            F.count(F.lit(1)).alias("copies"),
            *(F.first(name).alias(name) for name in ("text_id", "place", "places")),
        ),
        "pieces",
    )
    many = tables.write(_more_than(SHARD_PIECES, pieces, "fp"), "many")
    wanted = (
        pieces.join(many.withColumn("hashed", F.lit(True)), "fp", "left")
        .withColumn("hashed", F.coalesce("hashed", F.lit(False)))
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("fp", "piece", "copies", "hashed", "place", "places")).alias("wanted"))
    )
    schema = StructType.fromDDL("fp long, piece long, copies long, hashed boolean, bytes binary")

    def fetch():
        def work(batch):
            rows = {name: [] for name in schema.names}
            for content, list_ in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for one in list_:
                    for name in schema.names[:-1]:
                        rows[name].append(one[name])
                    rows["bytes"].append(content[one["place"] : one["place"] + one["places"] + rule.width - 1])
            return rows

        return work

    fetched = tables.write(arrow_map(texts.join(wanted, "text_id").select("text", "wanted"), fetch, schema, rows=64), "fetched")
    sharded = fetched.where("NOT hashed").repartition("fp").sortWithinPartitions("fp")
    strings = tables.write(_hashed_strings(fetched.where("hashed"), rule), "strings")
    twice = tables.write(_more_than(1, strings, "a", "b", weight="copies"), "twice")
    places = F.struct(F.col("place").alias("first"), F.col("place").alias("last"))
    hashed = strings.join(twice, ["a", "b"]).groupBy("fp", "piece").agg(F.collect_list(places).alias("ranges"))
    found = tables.write(_array_repeats(sharded, rule).unionByName(hashed), "found")
    tables.drop("pieces", "many", "fetched", "strings", "twice")
    placed = candidates.join(found, ["fp", "piece"]).groupBy("text_id").agg(
        F.collect_list(F.struct("place", "ranges")).alias("repeats")
    )
    return _without(texts.join(placed, "text_id", "left"), rule)


def _without(texts: DataFrame, rule: RepeatRule) -> DataFrame:
    schema = StructType.fromDDL(
        "text_id binary, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    )

    def start():
        def work(batch):
            ids, contents, copies, repeats = (batch.column(i) for i in range(4))
            rows = {name: [] for name in schema.names}
            rows["text_id"] = ids
            for content, count, list_ in zip(contents.cast(pa.binary()).to_pylist(), copies.to_pylist(), repeats.to_pylist()):
                spans = []
                if count > 1 and len(content) >= rule.width:
                    spans = [[0, len(content)]]
                else:
                    found = sorted((one["place"] + r["first"], one["place"] + r["last"]) for one in list_ or () for r in one["ranges"])
                    for first, last in found:
                        if spans and first <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], last + rule.width)
                        else:
                            spans.append([first, last + rule.width])
                edges = [0, *(edge for span in spans for edge in span), len(content)]
                rows["n_bytes"].append(len(content))
                rows["spans"].append([{"begin": a, "end": b} for a, b in spans])
                rows["kept"].append(b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2])))
            return rows

        return work

    return arrow_map(texts.select("text_id", "text", "copies", "repeats"), start, schema, rows=64)


def remove_repeats(docs: DataFrame, text: str = "text", rule: RepeatRule = RepeatRule()) -> DataFrame:
    """All rows and columns of ``docs``, with ``spans`` and what is ``kept`` of the text in place of columns of those names.

    A null text has no spans and keeps null.
    """
    found = distinct_texts(docs, text, rule).select(F.col("text_id").alias("_text_id"), "spans", "kept")
    rest = docs.drop("spans", "kept").withColumn("_text_id", text_id(text))
    joined = rest.join(found, "_text_id", "left").drop("_text_id")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))
