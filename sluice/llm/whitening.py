"""Whitening of embeddings by principal components.

The fit list is each distinct integer vector once.  Its size and sums, then its centred scatter, are added up in the
tasks from partial sums of fixed size; only the scatter, ``dimension`` squared numbers, reaches the driver.  There the
scatter is factored by Cholesky with diagonal pivoting, and one-sided Jacobi rotations make the columns of the
triangular factor orthogonal: their squared lengths are the eigenvalues of the scatter and the columns, at length 1,
its eigenvectors.  The covariance itself is never rotated, so small eigenvalues keep their relative precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut
from sluice.shipping import ship

#: Added to each scaled component.
OFFSET = 1_000_000
#: Numbers of scatter matrices that one plan gathers at most, unless a single dimension needs more.
MOST_NUMBERS = 4_000_000
#: The end of a long, at which deviations beyond it are held.
MOST = 2**63 - 1
#: A double near the ends of a long, at which components are held before the offset is added.
HELD = 2.0**63 - 2.0**22
#: Sweeps of rotations after which columns count as orthogonal; ten are usual.
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``f`` of full column rank with ``f @ f.T`` equal to the positive semidefinite ``a``, lower triangular but for the order of rows.

    Each step takes the largest remaining diagonal entry; what is left below rounding of the largest of all ends it.
    """
    rest = np.diag(a).astype(np.float64).copy()
    least = len(a) * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros_like(a, dtype=np.float64)
    free = np.ones(len(a), bool)
    for k in range(len(a)):
        p = int(np.argmax(np.where(free, rest, -np.inf)))
        if rest[p] <= least:
            return factor[:, :k]
        root = np.sqrt(rest[p])
        free[p] = False
        column = np.where(free, (a[:, p] - factor[:, :k] @ factor[p, :k]) / root, 0.0)
        column[p] = root
        factor[:, k] = column
        rest -= column * column
    return factor


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal to working precision.

    Pairs of columns are rotated as a round robin plays: in each round all columns meet in disjoint pairs.
    """
    f = factor.copy()
    n = f.shape[1]
    ring = list(range(n)) + ([-1] if n % 2 else [])
    tight = np.finfo(np.float64).eps * max(1, len(f))
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[:half], ring[half:][::-1]) if p >= 0 and q >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            u, v = f[:, i], f[:, j]
            a, b, c = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
            far = np.abs(c) > tight * np.sqrt(a * b)
            if not far.any():
                continue
            turned = True
            i, j, u, v, a, b, c = i[far], j[far], u[:, far], v[:, far], a[far], b[far], c[far]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            f[:, i], f[:, j] = cos * u - sin * v, sin * u + cos * v
        if not turned:
            break
    return f


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter by falling size, without those that rounding can't tell from 0, and unit eigenvectors as columns."""
    f = orthogonal_columns(pivoted_cholesky(scatter))
    size = np.sqrt((f * f).sum(0))
    order = np.argsort(-size, kind="stable")
    return size[order] ** 2, f[:, order] / size[order]


@dataclass
class Fit:
    """What is known of the vectors of one dimension; ``total`` are exact sums, ``axes`` columns of components over their deviation."""

    n: int
    total: list[int]
    axes: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float = 0.0

    def scaled_up(self, x: np.ndarray) -> np.ndarray:
        """``n * x - total``, exact: 64-bit integers where they suffice, else Python's."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
        if 2 * self.n * most < MOST:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled_up(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of squares of :meth:`scaled_up`, exact, held at the end of a long."""
        up = self.scaled_up(x)
        most = max(int(up.max(initial=0)), -int(up.min(initial=0)))
        if most * most * x.shape[1] < MOST:
            return (up.astype(np.int64) ** 2).sum(1)
        up = up.astype(object)
        return np.minimum((up * up).sum(1), MOST).astype(np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes


def _by_dimension(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension but 0; lists are not null."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values.reshape(-1, dim) if len(rows) == len(sizes) else values[starts[rows][:, None] + np.arange(dim)]


def _integers(vectors: pa.Array, factor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integers of the sound vectors of each dimension: ``floor(factor * c) + OFFSET``, held at the ends of a long."""
    there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    for rows, c in _by_dimension(vectors.drop_null()):
        c = c.astype(np.float64)  # a null component is not a number here
        sound = np.isfinite(c).all(1)
        with np.errstate(over="ignore"):
            up = np.clip(np.floor(c[sound] * factor), -HELD, HELD)
        yield there[rows[sound]], up.astype(np.int64) + OFFSET


def _added(vectors: DataFrame, part) -> dict[int, list]:
    """Sums over all vectors of what ``part`` gives for the vectors of one dimension in a batch: a few numbers, or arrays of fixed size.

    Every task adds up its batches and writes one row a dimension and array; these are added by key in the cluster.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_dimension(batch.column(0)):
                found = part(x)
                held[x.shape[1]] = held[x.shape[1]] + found if x.shape[1] in held else found
        dims, places, rows = [], [], []
        for dim, matrix in held.items():
            for k, row in enumerate(matrix):
                dims.append(dim), places.append(k), rows.append([str(v) if isinstance(v, int) else float(v).hex() for v in row.tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(places, pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["dim", "place", "row"])

    def number(v: str):
        return float.fromhex(v) if "x" in v or v in ("inf", "-inf", "nan") else int(v)

    def add(table: pa.Table) -> pa.Table:
        rows = [[number(v) for v in row] for row in table.column("row").to_pylist()]
        total = [sum(column) for column in zip(*rows)]
        written = [str(v) if isinstance(v, int) else v.hex() for v in total]
        return pa.table({"dim": table.column("dim")[:1], "place": table.column("place")[:1], "row": pa.array([written], pa.list_(pa.string()))})

    kind = "dim int, place int, row array<string>"
    found: dict[int, dict[int, list]] = {}
    for r in vectors.select("x").mapInArrow(partial, kind).groupBy("dim", "place").applyInArrow(add, kind).collect():
        found.setdefault(r["dim"], {})[r["place"]] = [number(v) for v in r["row"]]
    return {dim: [rows[k] for k in sorted(rows)] for dim, rows in found.items()}


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of each dimension in Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    if most * len(x) < MOST:
        return x.sum(0, keepdims=True).astype(object)
    return x.astype(object).sum(0, keepdims=True)


def fit(distinct: DataFrame, counts: dict[int, int], most: int) -> dict[int, Fit]:
    """Components of the distinct vectors ``x`` of each dimension, and how far from the identity the covariance of what they whiten is."""
    fits = {dim: Fit(counts[dim], [int(v) for v in rows[0]]) for dim, rows in _added(distinct, _sums).items()}

    def scatter(x: np.ndarray) -> np.ndarray:
        c = fits[x.shape[1]].centred(x)
        return c.T @ c

    def moments(x: np.ndarray) -> np.ndarray:
        z = fits[x.shape[1]].whitened(x)
        return np.r_[z.T @ z, z.sum(0, keepdims=True)] if z.shape[1] else np.zeros((1, 0))

    for dim, rows in _added(distinct, scatter).items():
        of, matrix = fits[dim], np.array(rows)
        values, axes = components((matrix + matrix.T) / 2)
        kept = min(most, len(values))
        of.explained = values[:kept] / np.trace(matrix) if kept else np.empty(0)
        of.axes = axes[:, :kept] / np.sqrt(values[:kept] / of.n)
    for dim, rows in _added(distinct, moments).items():
        of, matrix = fits[dim], np.array(rows)
        if of.axes.shape[1]:
            mean = matrix[-1] / of.n
            of.error = float(np.abs(matrix[:-1] / of.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def _plans(dims: list[int]) -> list[list[int]]:
    """Dimensions in groups whose scatter matrices are of bounded size together."""
    plans, room = [], 0
    for dim in sorted(dims):
        if not plans or dim * dim > room:
            plans.append([])
            room = MOST_NUMBERS
        plans[-1].append(dim)
        room -= dim * dim
    return plans


def whiten(df: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each sound vector and its first ``most`` components.

    Components become ``floor(factor * c) + OFFSET``.  Vectors that are null or hold null or non-finite components
    take no part.  Vectors of different dimension are fitted apart, ``n`` being the distinct vectors of that dimension.
    Repeated vectors count once in the fit and are all whitened; rows of a null key are whitened like others, repeated
    rows appear as often as they are there.  Components whose variance can't be told from 0 are left out: a table of
    one distinct vector, of empty vectors, or an empty table gives no rows.  Of equal eigenvalues either order is
    right.  Deviations beyond a long are held at its end, components at 4 million less than that.
    Only the two named columns are read, so other columns may have any name.  Vectors of ``d`` components cost ``d``
    squared numbers in the driver and each task.
    """
    spark = df.sparkSession
    ship(spark)
    kept = df[vector] if df.schema[vector].dataType.elementType.simpleString() in ("float", "double") else df[vector].cast("array<double>")
    rows = df.select(df[key].alias("k"), kept.alias("v"))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _integers(batch.column(0), factor):
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), lists], ["dim", "x"])

    # Spark's partial aggregation meets repeated vectors before the shuffle, so a vector of a third of all rows is no hot key.
    distinct = cut(rows.select("v").mapInArrow(integers, "dim int, x array<bigint>").distinct(), "distinct-vectors")
    counts = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    kind = f"k {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], kind)
    for dims in _plans(list(counts)):
        part = F.col("dim").isin(dims)
        fits = spark.sparkContext.broadcast(fit(distinct.where(part), counts, most))

        def whitened(batches: Iterator[pa.RecordBatch], fits=fits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in _integers(batch.column(1), factor):
                    of = fits.value[x.shape[1]]
                    m = of.axes.shape[1]
                    size = m * len(at)
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(at, m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(size, of.n, np.int64)),
                        pa.array(np.repeat(of.deviation(x), m)),
                        pa.array(of.whitened(x).ravel()),
                        pa.array(np.tile(of.explained, len(at))),
                        pa.array(np.full(size, of.error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = out.unionByName(rows.where(F.size("v").isin(dims)).mapInArrow(whitened, kind))
    return out.withColumnRenamed("k", key)
