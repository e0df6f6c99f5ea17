"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi rotations.

Entries become whole numbers (``floor(64 c) + 1000000``), so that the sums and the
scatter of all vectors are exact, whatever the order in which tasks add them.
Each task centres its vectors by the mean, rounded to whole numbers, and adds up
their products; what the rounding leaves is taken off exactly on the driver,
which only ever holds the sums: one number for each pair of dimensions.

There the covariance is factored by Cholesky's method with the largest
remaining variance as pivot, and one-sided Jacobi rotations are applied to the
columns of the triangular factor itself until they are orthogonal. Squared column
norms are then the eigenvalues, columns over their norms the components; the
product of the factor with itself, which would square its condition, is not formed
again.

Defined results: a row goes if its vector is null, empty, holds a null or
non-finite entry or has another length than most of the vectors (of equally many,
the shorter length counts). Numbers beyond 2**62 are cut there, as no long holds
them. Components whose variance is lost in rounding (of constant or dependent
dimensions) are left out, so there may be fewer than asked for; no row of a
table without variance is returned. A deviation that no long holds is null. Equal
rows get equal results; a null key is carried along.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, importable

COMPONENTS = 32
_SCALE, _OFFSET, _LARGEST = 64.0, 1_000_000, 2**62
_SWEEPS = 60
#: Sums travel as two parts of 18 digits and more, each safe in a decimal column.
_PART = 10**18


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: all of it bounded by the number of dimensions, squared."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column for each
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.variances]

    def centred(self, numbers: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        largest = self.n * int(np.abs(numbers).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < 2**62 else object
        return numbers.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ (self.components / np.sqrt(self.variances))

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        largest = int(np.abs(centred).max(initial=0))
        if largest * largest * centred.shape[1] < 2**63:
            return (centred * centred).sum(1).tolist()
        exact = [sum(int(v) * int(v) for v in row) for row in centred]
        return [value if value < 2**63 else None for value in exact]


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    numbers = np.floor(entries.astype(np.float64) * _SCALE)
    return np.clip(numbers, -float(_LARGEST), float(_LARGEST)).astype(np.int64) + _OFFSET


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """F with F F' = matrix, a column for each pivot; rows in the order of their pivots are triangular.

    A dimension of which only what rounding makes is left is no pivot.
    """
    size = len(matrix)
    rest = matrix.astype(float).copy()
    least = size * np.finfo(float).eps * rest.diagonal()
    columns, free = [], np.ones(size, bool)
    for _ in range(size):
        left = np.where(free & (rest.diagonal() > least), rest.diagonal(), 0.0)
        pivot = int(left.argmax())
        if left[pivot] <= 0:
            break
        column = np.where(free, rest[:, pivot] / np.sqrt(rest[pivot, pivot]), 0.0)
        rest -= np.outer(column, column)
        free[pivot] = False
        columns.append(column)
    return np.array(columns).T.reshape(size, len(columns))


def _rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs without a column in common."""
    players = list(range(count + count % 2))
    rounds = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(a, b) for a, b in zip(players[:half], players[:half - 1:-1]) if max(a, b) < count]
        rounds.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and unit columns of the factor after rotating its columns orthogonal."""
    columns = factor.T.copy()
    rounds = _rounds(len(columns))
    for _ in range(_SWEEPS):
        widest = 0.0
        for left, right in rounds:
            if not len(left):
                continue
            a, b = columns[left], columns[right]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            cosine = np.abs(ab) / np.sqrt(aa * bb)
            widest = max(widest, float(cosine.max()))
            turn = cosine > np.finfo(float).eps
            zeta = np.where(turn, (bb - aa) / np.where(turn, 2 * ab, 1.0), 0.0)
            tangent = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.sqrt(1 + tangent * tangent)
            sin = cos * tangent
            columns[left], columns[right] = cos[:, None] * a - sin[:, None] * b, sin[:, None] * a + cos[:, None] * b
        if widest <= len(columns) * np.finfo(float).eps:
            break
    norms = np.sqrt((columns * columns).sum(1))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (columns[order] / norms[order, None]).T


def usable(vector: str) -> Column:
    """Whether a vector has entries, and all of them are finite numbers."""
    entries = F.col(f"`{vector}`")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(entries) > 0) & ~bad, F.lit(False))


def usable_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector of the rows that count: finite, and as long as most are."""
    rows = vectors.select(F.col(f"`{key}`"), F.col(f"`{vector}`")).where(usable(vector))
    length = F.size(F.col(f"`{vector}`"))
    sizes = rows.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "length").first()
    return rows.where(length == (common["length"] if common else 0))


def _matrix(batch) -> np.ndarray:
    column = batch.column(1)
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))


def _products(block: np.ndarray, largest: int) -> np.ndarray:
    """Sums of products of the columns, exact: in doubles where they hold them."""
    if largest * largest * len(block) < 2**53:
        half = block.astype(float)
        return (half.T @ half).astype(np.int64).astype(object)
    wide = block.astype(object)
    return wide.T @ wide


def _partial_sums(rows: DataFrame, add, order: int) -> DataFrame:
    """Sums over each task's blocks, a row for each number, added up over the tasks by Spark."""
    schema = T.StructType(
        [T.StructField(f"i{k}", T.IntegerType()) for k in range(order)]
        + [T.StructField(name, T.DecimalType(38, 0)) for name in ("high", "low")]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = add(_matrix(batch.slice(at, 1024)))
                total = part if total is None else total + part
        if total is None:
            return
        places = np.argwhere(np.ones(total.shape, bool))
        if order == 2:
            places = places[places[:, 0] <= places[:, 1]]
        values = [int(total[tuple(place)]) for place in places]
        columns = [pa.array(places[:, k], pa.int32()) for k in range(order)]
        columns += [
            pa.array([Decimal(part(v)) for v in values], pa.decimal128(38, 0))
            for part in (lambda v: v // _PART, lambda v: v % _PART)
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    parts = rows.mapInArrow(run, schema)
    return parts.groupBy(*(f"i{k}" for k in range(order))).agg(
        F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low")
    )


def _whole(row) -> int:
    return int(row["high"]) * _PART + int(row["low"])


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Means, components and variances of all usable rows, in three passes of partial sums.

    The last pass measures how far the covariance of the whitened vectors is
    from the identity.
    """
    importable(vectors.sparkSession)
    rows = usable_rows(vectors, key, vector)

    # The count travels as one more number behind the sums.
    def counted(block):
        safe = int(np.abs(block).max()) * len(block) < 2**62
        return np.array([*(block if safe else block.astype(object)).sum(0).tolist(), len(block)], object)

    found = {row["i0"]: _whole(row) for row in _partial_sums(rows, counted, 1).collect()}
    if not found:
        return Whitening(0, [], np.empty((0, 0)), np.empty(0), 0.0)
    *sums, n = (found[i] for i in range(len(found)))
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def scattered(block):
        block = block - middle
        return _products(block, int(np.abs(block).max(initial=0)))

    left = [s - n * int(m) for s, m in zip(sums, middle)]
    covariance = np.zeros((len(sums), len(sums)))
    for row in _partial_sums(rows, scattered, 2).collect():
        i, j = row["i0"], row["i1"]
        covariance[i, j] = covariance[j, i] = (n * _whole(row) - left[i] * left[j]) / (n * n)
    trace = float(covariance.trace())
    variances, directions = one_sided_jacobi(pivoted_cholesky(covariance))
    keep = slice(0, min(components, len(variances)))
    model = Whitening(n, sums, directions[:, keep], variances[keep], trace)
    return Whitening(n, sums, model.components, model.variances, trace, _identity_error(rows, model))


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    size = len(model.variances)
    schema = "i int, j int, total double"

    def run(batches):
        import pyarrow as pa

        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                block = model.whitened(model.centred(_matrix(batch.slice(at, 1024))))
                total += np.column_stack([block.T @ block, block.sum(0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
            names=["i", "j", "total"],
        )

    if not size:
        return 0.0
    total = np.zeros((size, size + 1))
    for row in rows.mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[row["i"], row["j"]] = row["total"]
    mean = total[:, size] / model.n
    return float(np.abs(total[:, :size] / model.n - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Key, ``deviation`` and ``whitened`` (an entry for each component) of every usable row."""
    rows = usable_rows(vectors, key, vector)
    schema = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )

    def start():
        def work(batch):
            centred = model.centred(_matrix(batch))
            return {
                key: batch.column(0),
                "deviation": model.deviations(centred),
                "whitened": model.whitened(centred).tolist(),
            }

        return work

    return arrow_map(rows, start, schema, rows=1024)
