"""N-gram Jaccard join with prefixes of token combinations.

Tokens are the hashed word shingles of a document; documents with equal sets
are one set from the start. Two sets x and y can only reach the similarity if
each lacks at most ``tau = n - ceil(threshold * n)`` tokens of the other. With
all tokens in one global order, rare ones first, both keep a prefix; if the
last prefix token of x comes no later than that of y, every token of x's prefix
that y has lies in y's prefix too. Frequent tokens are indexed by combinations:
a token of class k counts only together with k - 1 others of its class (and of
its part, a hash division that keeps combinations few). A part with m tokens
loses all its combinations only if m - k + 1 tokens are missing, so the prefix
is extended until these numbers add up to ``tau + 1``: then linked sets share a
whole combination. Combinations of class 1 are single tokens.

Work and data flow:

1. Tasks hash whole texts to sets; only id, size and digest leave them.
2. Tasks hash again and send (token, set) pairs in packed blocks by token range.
   A token that one task sees in many sets is sent as a notice, its sets
   go elsewhere, so no range receives a hot token's sets. Copies inside a task are
   merged before anything is sent. Tokens of one set only end here: they
   cannot be shared, and count as missing for sure.
3. A set that has too few shared tokens for any partner ends here.
4. Sets meet in the lists of their combinations. First each list is tied to its
   leader only, the set with the fewest tokens of its own, and the links found
   make components. Then pairs of a list whose components differ are compared,
   if sizes and shared tokens leave a chance. Sets of one component need no
   further comparison, so a large group of near copies costs a star and not all
   pairs.
5. Links become components by alternating stars on written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, begin, importable, only, small_batches
from mercato.operators.durable import OwnedTables, written

U64 = np.uint64
#: Shingles a task packs at once, about 40 bytes each while they are sorted.
CHUNK_SHINGLES = 700_000
#: Sets in one packed chunk from which on a token is sent as a notice.
HOT_SETS = 64
#: Stands for the number of sets of such a token.
MANY = 2**31 - 1
#: Token ranges for each shuffle partition; several, so that partitions get even shares.
RANGES_PER_PARTITION = 4
#: Longs of a set's parity sketch.
SKETCH = 4


@dataclass(frozen=True)
class JoinRule:
    """Shingle width, similarity as ``percent`` of the union, and the token classes.

    ``classes``: up to how many sets a token may be in to be of class 1, 2, ...;
    all beyond the last bound are of the next class. ``parts``: parts of a class
    above 1 for each token of a set's size level; at most 0.2, or short
    sets could run out of tokens.
    """

    width: int = 4
    percent: int = 85
    classes: tuple[int, ...] = (8, 256)
    parts: float = 0.2

    def needed(self, size):
        """Least shared tokens of a set of ``size`` with any partner."""
        return -(-self.percent * size // 100)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U64)


def _powers(count: int) -> np.ndarray:
    factors = np.full(count, _BASE, U64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWERS = _powers(64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    inside = ~_SPACES[raw]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    return _mix(np.add.reduceat((raw[inside].astype(U64) + U64(1)) * powers[place], firsts))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no word none."""
    words = word_hashes(text) if text else np.zeros(0, U64)
    if not len(words):
        return words
    take = min(width, len(words))
    total = np.full(len(words) - take + 1, take, U64)
    for i in range(take):
        total += words[i : len(words) - take + 1 + i] * (_PLACES[i % 4] + U64(2 * (i // 4)))
        total = (total << U64(7)) | (total >> U64(57))
    return np.unique(_mix(total))


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit digest that stands for the set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def measure_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Key, ``n_shingles`` and ``set_id`` (null for the empty set) of every row."""
    source = only(docs, key, text)
    schema = T.StructType(
        [
            T.StructField(key, source.schema[key].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_id", T.LongType()),
        ]
    )

    def start():
        def work(batch):
            sets = [shingle_set(content, width) for content in batch.column(1).to_pylist()]
            return {
                key: batch.column(0),
                "n_shingles": [len(tokens) for tokens in sets],
                "set_id": [set_id(tokens) if len(tokens) else None for tokens in sets],
            }

        return work

    return arrow_map(source, start, schema)


# ---- tokens by range -------------------------------------------------------------------------

_PACKED = "range int, kind int, count int, bytes int, tokens binary, owners int, sets binary"
_PAIRS, _NOTICE, _HOT_PAIRS = 0, 1, 2


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted numbers as the low bytes of their differences, byte by byte."""
    steps = np.diff(values, prepend=U64(0))
    rest = steps.copy()
    rest[0] = 0
    size = max(1, (int(rest.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :size].T.copy()
    return size, int(values[0]).to_bytes(8, "little") + planes.tobytes()


def _unpack(raw: bytes, count: int, size: int) -> np.ndarray:
    steps = np.zeros((count, 8), np.uint8)
    steps[:, :size] = np.frombuffer(raw, np.uint8, offset=8).reshape(size, count).T
    steps = steps.view(U64).ravel()
    steps[0] = int.from_bytes(raw[:8], "little")
    return np.cumsum(steps, dtype=U64)


def _pack_owners(owners: np.ndarray, ids: np.ndarray) -> tuple[int, bytes]:
    """Sets of a block once each, then for every token the place of its set among them."""
    used, place = np.unique(owners, return_inverse=True)
    return len(used), ids[used].tobytes() + place.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes()


def _unpack_owners(raw: bytes, count: int) -> np.ndarray:
    kind = np.uint16 if count <= 1 << 16 else np.uint32
    return np.frombuffer(raw, np.int64, count)[np.frombuffer(raw, kind, offset=8 * count)]


def _distinct_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sets and tokens of all parts, by token and set, each pair once; empties ``parts``."""
    owners, tokens = np.concatenate([part[0] for part in parts]), np.concatenate([part[1] for part in parts])
    parts.clear()
    order = np.lexsort((owners, tokens))
    owners = owners[order]
    tokens = tokens[order]
    del order
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    if fresh.all():
        return owners, tokens
    owners = owners[fresh]
    return owners, tokens[fresh]


def _firsts(tokens: np.ndarray) -> np.ndarray:
    """Where each token of a sorted row begins."""
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    return np.flatnonzero(new)


def _pack_chunk(sets: dict[int, np.ndarray], ranges: int) -> pa.RecordBatch:
    ids = np.fromiter(sets, np.int64, len(sets))
    tokens = np.concatenate(list(sets.values()))
    owners = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(some) for some in sets.values()])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    first = _firsts(tokens)
    repeats = np.diff(np.append(first, len(tokens)))
    hot = np.repeat(repeats >= HOT_SETS, repeats)
    rows: list[tuple] = []

    def send(kind: int, tokens: np.ndarray, owners: np.ndarray | None, where: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(where)) + 1
        for low, high in zip([0, *edges], [*edges, len(where)], strict=True):
            size, packed = _pack(tokens[low:high])
            sets = (0, b"") if owners is None else _pack_owners(owners[low:high], ids)
            rows.append((int(where[low]), kind, high - low, size, packed, *sets))

    def range_of(tokens: np.ndarray) -> np.ndarray:
        return ((tokens >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)

    if not hot.all():
        send(_PAIRS, tokens[~hot], owners[~hot], range_of(tokens[~hot]))
    if hot.any():
        send(_NOTICE, hots := tokens[first[repeats >= HOT_SETS]], None, range_of(hots))
        # The sets of hot tokens go by set, with their own tokens in order.
        tokens, owners = tokens[hot], owners[hot]
        where = (_mix(ids.view(U64)) % U64(ranges)).astype(np.int64)[owners]
        order = np.lexsort((tokens, where))
        send(_HOT_PAIRS, tokens[order], owners[order], where[order])
    names = ("range", "kind", "count", "bytes", "tokens", "owners", "sets")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def shared_tokens(docs: DataFrame, text: str, rule: JoinRule) -> DataFrame:
    """``set_id``, ``token`` and ``sets`` (how many sets have it) for tokens of two sets or more."""
    spark = docs.sparkSession
    importable(spark)
    small_batches(spark)
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width, least = rule.width, smallest_linked(rule)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shared_tokens")
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for content in batch.column(0):
                tokens = shingle_set(content.as_py(), width)
                if len(tokens) < least:
                    continue
                owner = set_id(tokens)
                if owner not in sets:
                    sets[owner] = tokens
                    size += len(tokens)
                if size >= CHUNK_SHINGLES:
                    yield _pack_chunk(sets, ranges)
                    sets, size = {}, 0
        if sets:
            yield _pack_chunk(sets, ranges)

    def count(table: pa.Table) -> pa.Table:
        begin("counted_tokens")
        pairs: dict[int, list] = {_PAIRS: [], _NOTICE: [], _HOT_PAIRS: []}
        names = ("kind", "count", "bytes", "tokens", "owners", "sets")
        for kind, n, size, tokens, owners, sets in zip(*(table.column(name).to_pylist() for name in names), strict=True):
            pairs[kind].append((_unpack_owners(sets, owners), _unpack(tokens, n, size)))
        out = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
        if pairs[_HOT_PAIRS]:
            owners, tokens = _distinct_pairs(pairs[_HOT_PAIRS])
            out.append((owners, tokens, np.full(len(tokens), MANY)))
        if pairs[_PAIRS]:
            owners, tokens = _distinct_pairs(pairs[_PAIRS])
            first = _firsts(tokens)
            repeats = np.diff(np.append(first, len(tokens)))
            seen = repeats
            if pairs[_NOTICE]:
                noticed = np.concatenate([tokens for _, tokens in pairs[_NOTICE]])
                seen = np.where(np.isin(tokens[first], noticed), MANY, repeats)
            shared = np.repeat(seen > 1, repeats)
            out.append((owners[shared], tokens[shared], np.repeat(seen[seen > 1], repeats[seen > 1])))
            del owners, tokens, first, repeats, seen, shared
        columns = [np.concatenate(part) for part in zip(*out, strict=True)]
        return pa.table(
            {
                "set_id": pa.array(columns[0], pa.int64()),
                "token": pa.array(columns[1].view(np.int64), pa.int64()),
                "sets": pa.array(columns[2], pa.int32()),
            }
        )

    packed = only(docs, text).mapInArrow(send, _PACKED)
    return packed.groupBy("range").applyInArrow(count, "set_id long, token long, sets int")


# ---- combinations ----------------------------------------------------------------------------


def smallest_linked(rule: JoinRule) -> int:
    """Least size of a set that can be linked with a different one: n of n + 1 tokens."""
    return -(-rule.percent // (100 - rule.percent)) if rule.percent < 100 else 1 << 60


def combination_keys(size: int, tokens: list[int], sets: list[int], rule: JoinRule) -> list[int]:
    """Keys of the combinations in a set's prefix.

    ``tokens``: the shared ones, in the global order (number of sets, then token).
    The size level fixes the parts; a set also keys itself for the next level
    if a larger partner can be there.
    """
    allowed = size - rule.needed(size)
    keys: set[int] = set()
    top = size * 100 // rule.percent
    for level in {size.bit_length(), top.bit_length()}:
        parts = max(1, int(rule.parts * 2 ** (level - 1)))
        kept: dict[tuple[int, int], list[int]] = {}
        credit = size - len(tokens)  # tokens of no other set come first and count one each
        for token, seen in zip(tokens, sets, strict=True):
            if credit > allowed:
                break
            k = 1 + sum(seen > bound for bound in rule.classes)
            if k == 1:
                keys.add(token)
                credit += 1
                continue
            part = kept.setdefault((k, (token & 0xFFFFFFFF) % parts), [])
            part.append(token)
            if len(part) >= k:
                credit += 1
                # The newest token with every k - 1 earlier ones of its part.
                keys.update(hash((level, k, *some, token)) for some in combinations(part[:-1], k - 1))
    return list(keys)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of tokens falls on each of 64 * SKETCH places.

    Where two sketches differ, the sets differ in at least one token.
    """
    places = np.bincount((tokens.view(U64) >> U64(20)) % U64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").view(np.int64)


SKETCHES = tuple(f"sketch_{i}" for i in range(SKETCH))


def index_combinations(sets: DataFrame, rule: JoinRule) -> DataFrame:
    """A row for each set and combination key: ``combination``, ``node``, ``n``, ``own``, sketch.

    ``own`` is the number of tokens that no other set has.
    """
    source = only(sets, "node", "n", "tokens", "seen")
    importable(sets.sparkSession)
    small_batches(sets.sparkSession)

    def run(batches):
        begin("combinations")
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                keys = [combination_keys(n, tokens, seen, rule) for _, n, tokens, seen in rows]
                repeat = [len(k) for k in keys]
                index = np.repeat(np.arange(len(rows)), repeat)
                own = np.array([n - len(tokens) for _, n, tokens, _ in rows], np.int64)
                sketch = np.array([parity_sketch(np.array(tokens, np.int64)) for _, _, tokens, _ in rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key for some in keys for key in some], pa.int64()),
                        part.column(0).take(pa.array(index)),
                        part.column(1).take(pa.array(index)),
                        pa.array(own[index], pa.int64()),
                        *(pa.array(sketch[index, i], pa.int64()) for i in range(SKETCH)),
                    ],
                    ["combination", "node", "n", "own", *SKETCHES],
                )

    node = sets.schema["node"].dataType
    schema = T.StructType(
        [
            T.StructField("combination", T.LongType()),
            T.StructField("node", node),
            T.StructField("n", T.LongType()),
            T.StructField("own", T.LongType()),
            *(T.StructField(name, T.LongType()) for name in SKETCHES),
        ]
    )
    return source.mapInArrow(run, schema)


# ---- pairs and components --------------------------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame, rule: JoinRule) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .where(100 * common >= rule.percent * (F.col("n_a") + F.col("n_b") - common))
        .select("a", "b")
    )


def _promising(a, b, rule: JoinRule):
    """Whether two sets can reach the similarity, by what surely tells them apart.

    ``a`` and ``b`` give the columns n, own and the sketch of both. Tokens of
    their own and places where the sketches differ are different tokens, and
    with sizes of sum s the similarity allows (100 - p) * s / (100 + p) of them.
    """
    apart = a("own") + b("own")
    for name in SKETCHES:
        apart = apart + F.bit_count(a(name).bitwiseXOR(b(name)))
    total = a("n") + b("n")
    shared = F.least(a("n") - a("own"), b("n") - b("own"))
    return ((100 + rule.percent) * apart <= (100 - rule.percent) * total) & (
        (100 + rule.percent) * shared >= rule.percent * total
    )


def connected_components(tables: OwnedTables, edges: DataFrame, label: str) -> DataFrame:
    """``node`` and ``component``, its least reachable node, for nodes ``a``, ``b`` of the edges.

    Alternating large and small stars: every round ties neighbours to the least
    neighbour, on tables in the shared folder, until nothing changes. A node
    with many neighbours is met by joins that Spark can split, never in a list.
    """
    current = tables.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{label}-0",
    )
    step = 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        following = tables.write(following, f"{label}-{step}")
        changed = following.exceptAll(current).isEmpty() and current.exceptAll(following).isEmpty()
        tables.drop(f"{label}-{step - 1}")
        current = following
        if changed:
            break
    # Every node now points at its component's least node.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rule: JoinRule = JoinRule(),
) -> DataFrame:
    """One row for every document: the key, ``n_shingles`` and ``component_id``.

    ``component_id`` is the least key reachable over links, the row's own
    included. A null or word-free text has size 0 and its own component. Rows
    with equal sets are linked whatever their key; a row with a null key is
    linked like any other but never names a component. Ties do not arise: all
    is counted in whole numbers. Other columns are not read.

    Sets are told apart by 64-bit digests of 64-bit shingle hashes.
    """
    spark: SparkSession = docs.sparkSession
    tables = OwnedTables(spark, "ngram-join")
    measured = tables.write(measure_sets(docs, key, text, rule.width), "measured")
    # Written, so that later joins with a set of very many copies are between plain tables, which Spark splits.
    classes = tables.write(
        measured.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min(key).alias("node"), F.max("n_shingles").alias("n"))
        .where("node IS NOT NULL"),
        "classes",
    )
    least = smallest_linked(rule)
    needed = F.ceil(F.col("n") * rule.percent / F.lit(100))
    gathered = (
        shared_tokens(docs, text, rule)
        .groupBy("set_id")
        # A token may reach a set's copies in two ways; it is one token.
        .agg(F.sort_array(F.collect_set(F.struct("sets", "token"))).alias("shared"))
    )
    sets = tables.write(
        classes.where(F.col("n") >= least)
        .join(gathered, "set_id")
        .where(F.size("shared") >= needed)
        .select("node", "n", F.col("shared.token").alias("tokens"), F.col("shared.sets").alias("seen")),
        "sets",
    )
    keyed = tables.write(index_combinations(sets, rule), "combinations")

    # Each list of a combination is tied to its leader.
    leaders = (
        keyed.groupBy("combination")
        .agg(F.min(F.struct("own", "node", "n", *SKETCHES)).alias("leader"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .select("combination", "leader")
    )
    lead = F.col("leader")
    ties = tables.write(
        keyed.join(leaders, "combination")
        .where(F.col("node") != lead["node"])
        .where(_promising(F.col, lead.getField, rule))
        .select(F.least("node", lead["node"]).alias("a"), F.greatest("node", lead["node"]).alias("b"))
        .distinct(),
        "ties",
    )
    links = tables.write(_verified(ties, sets, rule), "links")
    component = tables.write(connected_components(tables, links, "first"), "component")

    # Pairs of a list that are in different components, and not compared yet.
    placed = keyed.join(component, "node", "left").select(
        "combination", "node", "n", "own", *SKETCHES, F.coalesce("component", "node").alias("component")
    )
    open_lists = (
        placed.groupBy("combination")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("combination")
    )
    placed = tables.write(placed.join(open_lists, "combination", "left_semi"), "placed")
    other = placed.select("combination", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "own", "component", *SKETCHES)))
    rest = tables.write(
        placed.join(other, "combination")
        .where("node < node_b AND component <> component_b")
        .where(_promising(F.col, lambda name: F.col(f"{name}_b"), rule))
        .select(F.col("node").alias("a"), F.col("node_b").alias("b"))
        .distinct(),
        "rest",
    ).join(ties, ["a", "b"], "left_anti")
    more = tables.write(_verified(rest, sets, rule), "more")
    final = tables.write(connected_components(tables, links.unionByName(more), "last"), "final")
    result = tables.write(
        measured.join(classes.select("set_id", "node"), "set_id", "left")
        .join(final, "node", "left")
        .select(
            key,
            "n_shingles",
            F.coalesce("component", "node", key).alias("component_id"),
        ),
        "result",
    )
    tables.drop("measured", "classes", "sets", "combinations", "ties", "links", "component", "placed", "rest", "more", "final")
    return result


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: JoinRule = JoinRule()) -> DataFrame:
    """The documents, with their columns, that name their component: one of each group.

    The kept document is the one with the least key. Rows with a null key stay,
    nothing can be told apart by them; repeated rows of a kept key stay too.
    """
    names = near_duplicates(docs, key, text, rule).where(f"`{key}` <> component_id")
    # Written, so that Spark knows its size and decides by it whether to broadcast.
    gone = written(names.select(F.col(key).alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
