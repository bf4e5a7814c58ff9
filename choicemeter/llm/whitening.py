"""Whitening of embeddings with a spectral divide-and-conquer by polar decompositions.

Two passes over the vectors give their sums and their centred covariance: each task adds
up its own rows, and Spark adds up the tasks' matrices entry by entry.  The driver then
works on one matrix of the vectors' dimension: the polar factor of the covariance less a
shift, found by the QR-based dynamically weighted Halley iteration (QDWH), is the sign
of that matrix, and half of identity plus sign projects onto the components above the
shift.  Bases of the projector's range and null space split the problem in two, again
and again, until single components are left.  Halves that hold none of the wanted
components are not split further.  The whitening matrix is broadcast; its size depends on
the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
# Entries beyond this are no finite numbers of this operator: their integer form would not be exact.
LARGEST = 2.0**31
# Rows handled at once.
ROWS = 1 << 14


def halley(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign, where no eigenvalue is 0."""
    size = len(a)
    norm = np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())
    x, low, identity = a / norm, 1e-16, np.eye(size)  # low: below the least singular value
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        first = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, identity]))
        ahead = second / third * x + (first - second / third) / np.sqrt(third) * q[:size] @ q[size:].T
        ahead = (ahead + ahead.T) / 2
        moved, x = np.abs(ahead - x).max(), ahead
        low = min(1.0, low * (first + second * square) / (1 + third * square))
        if moved < 1e-13 or (low > 1 - 1e-15 and moved < 1e-8):
            break
    return x


def halves(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the components above and below the shift, and what is left between them; None: no such split."""
    size = len(a)
    projector = (halley(a - shift * np.eye(size)) + np.eye(size)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < size:
        return None
    basis = rng.standard_normal((size, rank))
    for _ in range(2):
        basis = np.linalg.qr(projector @ basis[:, :rank], mode="complete")[0]
    above, below = basis[:, :rank], basis[:, rank:]
    return above, below, float(np.abs(below.T @ a @ above).max())


def shifts(a: np.ndarray) -> Iterator[float]:
    """Where to split: the median of the diagonal, else the mean and places around it.

    The mean of the eigenvalues lies between the least and the greatest.
    """
    diagonal, size = np.diag(a), len(a)
    mean = np.trace(a) / size
    spread = np.sqrt(max(0.0, np.square(a - mean * np.eye(size)).sum() / size))
    yield float(np.median(diagonal))
    for step in (0.0, 0.1, -0.1, 0.25, -0.25, 0.5, -0.5, 0.9, -0.9, 1.2, -1.2):
        yield float(mean + step * spread)


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the ``wanted`` greatest components of a symmetric matrix."""
    rng = np.random.default_rng(0)
    small = 4 * np.finfo(float).eps * max(np.linalg.norm(a), np.finfo(float).tiny)

    def split(block: np.ndarray, basis: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        size = len(block)
        loose = block - np.diag(np.diag(block))
        if size == 1 or np.abs(loose).max() <= small:
            # single components, or equal ones, of which any basis does
            order = np.argsort(-np.diag(block), kind="stable")[:wanted]
            return np.diag(block)[order], basis[:, order]
        best = None
        for shift in shifts(block):
            found = halves(block, shift, rng)
            if found and (best is None or found[2] < best[2]):
                best = found
            if best and best[2] <= 64 * small * size:
                break
        if best is None:  # they differ by rounding only
            return np.diag(block)[:wanted], basis[:, :wanted]
        above, below, _ = best
        values, vectors = split(symmetric(above.T @ block @ above), basis @ above, wanted)
        if len(values) < wanted:
            more, others = split(symmetric(below.T @ block @ below), basis @ below, wanted - len(values))
            values, vectors = np.append(values, more), np.hstack([vectors, others])
        return values, vectors

    values, vectors = split(symmetric(a), np.eye(len(a)), min(wanted, len(a)))
    vectors = refined(a, vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def refined(a: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns once more, with the rounding of the splits above them taken out to first order."""
    for _ in range(2):
        vectors = np.linalg.qr(vectors)[0]
        inner = symmetric(vectors.T @ a @ vectors)
        values = np.diag(inner)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 1e-9 * np.abs(values).max()
        vectors = vectors + vectors @ np.where(apart, inner / np.where(apart, gap, 1), 0)
    return np.linalg.qr(vectors)[0]


def clean(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only, none beyond LARGEST."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)
    return df.where(F.col(column).isNotNull() & ~F.exists(F.col(column).cast("array<double>"), bad))


def integers(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors' entries times 64, floored and shifted, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dimension) + SHIFT


def totals(vectors: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number and sums of the integer vectors of the most frequent dimension, the greatest of those equally frequent."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            x = batch.column(column)
            size = np.diff(x.offsets.to_numpy())
            for dimension in np.unique(size):
                rows = integers(x.filter(pa.array(size == dimension)), int(dimension)) if dimension else np.zeros((0, 0), np.int64)
                n, sums = held.get(int(dimension), (0, 0))
                held[int(dimension)] = (n + int((size == dimension).sum()), sums + rows.sum(0))
        for dimension, (n, sums) in held.items():
            yield pa.RecordBatch.from_pydict({"dimension": pa.array([dimension], pa.int32()), "n": [n], "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    parts = vectors.select(column).mapInArrow(add, "dimension int, n long, sums array<long>")
    # place -1 has the number of rows
    entries = parts.select("dimension", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "sum"))
    whole = entries.groupBy("dimension", "place").agg(F.sum("sum").alias("sum"))
    top = whole.where("place = 0 and dimension > 0").orderBy(F.desc("sum"), F.desc("dimension")).first()
    if top is None:
        return 0, np.zeros(0, np.int64)
    rows = whole.where(F.col("dimension") == top.dimension).orderBy("place").collect()  # as many as dimensions, and one
    return int(top["sum"]), np.array([r["sum"] for r in rows[1:]], np.int64)


def of_dimension(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    return vectors.where((F.size(column) == dimension) & (F.size(column) > 0))


def products(vectors: DataFrame, column: str, dimension: int, project, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of what ``project`` makes of the integer vectors; added up over tasks by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, square = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                y = project(integers(batch.column(column).slice(a, ROWS), dimension))
                sums += y.sum(0)
                square += y.T @ y
        yield pa.RecordBatch.from_pydict({"entries": pa.array([np.append(sums, square[np.triu_indices(width)]).tolist()], pa.list_(pa.float64()))})

    parts = of_dimension(vectors, column, dimension).select(column).mapInArrow(add, "entries array<double>")
    whole = parts.select(F.posexplode("entries").alias("place", "entry")).groupBy("place").agg(F.sum("entry").alias("entry"))
    entries = np.zeros(width + width * (width + 1) // 2)
    for r in whole.collect():  # as many as the matrix has entries
        entries[r.place] = r.entry
    square = np.zeros((width, width))
    square[np.triu_indices(width)] = entries[width:]
    return entries[:width], square + np.triu(square, 1).T


@dataclass
class Whitening:
    """n vectors with sums S; variances (falling) and unit directions (columns) of the leading components; the whole variance."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    directions: np.ndarray
    total: float
    identity_error: float = 0.0

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total else self.variances

    def matrix(self) -> np.ndarray:
        return self.directions / np.sqrt(self.variances)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the whole part taken off in integers first."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - S) ** 2 of each row, exactly; null beyond 64 bits."""
        far = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if far < 1 << 62:
            apart = self.n * x - self.sums
            widest = int(np.abs(apart).max(initial=0))
            if widest * widest * max(1, x.shape[1]) < 1 << 63:
                return pa.array(np.square(apart).sum(1), pa.int64())
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def fit(vectors: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> Whitening:
    """The whitening of all clean vectors; components without variance are left out.

    ``identity_error`` is measured: the covariance of the whitened vectors in a pass of its own.
    """
    n, sums = totals(vectors, column)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    _, square = products(vectors, column, model.dimension, model.centred, model.dimension)
    covariance = symmetric(square / n)
    model.total = float(np.trace(covariance))
    if not model.total:
        return model
    values, directions = components(covariance, wanted)
    some = values > max(1e-12 * values[0], 0)
    model.variances, model.directions = values[some], directions[:, some]
    sent = vectors.sparkSession.sparkContext.broadcast(vars(model))
    width = int(some.sum())

    def project(x: np.ndarray) -> np.ndarray:
        own = Whitening(**sent.value)
        return own.centred(x) @ own.matrix()

    means, square = products(vectors, column, model.dimension, project, width)
    model.identity_error = float(np.abs(square / n - np.outer(means / n, means / n) - np.eye(width)).max())
    return model


def transform(vectors: DataFrame, model: Whitening, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep``, deviation (long) and whitened (array<double>, a value per component) of every clean vector of the fitted dimension."""
    sent: Broadcast = vectors.sparkSession.sparkContext.broadcast(vars(model))  # plain values, so that workers need no copy of the class

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Whitening(**sent.value)
        matrix = model.matrix()
        width = matrix.shape[1]
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                x = integers(some.column(column), model.dimension)
                whitened = pa.array((model.centred(x) @ matrix).ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, whitened)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), model.deviations(x), lists], [*keep, "deviation", "whitened"])

    slim = of_dimension(vectors, column, model.dimension).select(*keep, column)
    schema = T.StructType([*(slim.schema[c] for c in keep), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return slim.mapInArrow(whiten, schema)


def whitened(df: DataFrame, column: str = "embedding", key: str = "vec_id", wanted: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries (or some beyond 2^31)
    are left out; they are no part of the fit.  Vectors of another dimension than
    most have are left out, too, the empty vector always.  Components without variance give no
    rows, so equal vectors, one vector alone, or an empty table give none.  Rows with a null
    or repeated key are whitened one by one.  Other columns are ignored.
    """
    vectors = clean(df.select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias(column)), column)
    model = fit(vectors, column, wanted)
    rows = transform(vectors, model, column, (key,))
    each = rows.select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.get(F.array(*(F.lit(float(x)) for x in [*model.explained, 0.0])), F.col("place"))
    return each.select(
        key,
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
