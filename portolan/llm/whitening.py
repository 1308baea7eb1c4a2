"""Whitening of embeddings with mixed-precision refinement of the eigenvectors.

Spark sums the covariance; the driver only ever holds one number per pair of
dimensions. Its eigenvectors are found in single precision and corrected by the
iteration of Ogita and Aishima, which consists of matrix multiplications in
extended precision and converges quadratically where eigenvalues are apart. Where
some lie together, the correction inside their span is undefined; there the small
problem of that span alone, shifted to the middle of the cluster, is solved
instead, and the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import stored

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this, far outside any embedding, count as this.
FAR = 2.0**60
STEPS = 30
#: Eigenvalues closer than this many times the present error are one cluster.
APART = 1000
#: Rows that a task works on together.
ROWS = 4_000


# --- eigenvectors --------------------------------------------------------------------------------


def _clusters(values: np.ndarray, apart: float) -> np.ndarray:
    """Number of the cluster of each eigenvalue; neighbours up to ``apart`` from each other share one."""
    order = np.argsort(values)
    number = np.empty(len(values), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(np.diff(values[order]) > apart)))
    return number


def _orthogonal(x: np.ndarray) -> np.ndarray:
    """Columns made orthogonal by two steps of Newton and Schulz, each squaring the error."""
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def _turn(small: np.ndarray) -> np.ndarray:
    """Eigenvectors of the small problem of a cluster, orthogonal in the precision of ``small``."""
    _, turn = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))
    return _orthogonal(turn.astype(small.dtype))


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric ``a`` from approximate ones, in the precision of ``a``.

    A step corrects pairs of vectors whose eigenvalues differ by much more than
    the error; ``APART`` bounds the correction, so that every step gains at least
    that factor. It moves vectors by more than the error, so they are made
    orthogonal again. The span of a cluster is turned by its own eigenvectors.
    """
    eps, norm = np.finfo(a.dtype).eps, np.sqrt((a * a).sum())
    best, kept = np.inf, None
    for _ in range(STEPS):
        r = np.eye(len(a), dtype=a.dtype) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        if error < best:
            kept = values, x
        if error <= 4 * eps * norm or error > best / 2:
            break  # as exact as the arithmetic, or no longer improving
        best = error
        number = _clusters(values, APART * error)
        far = number[:, None] != number[None, :]
        x = _orthogonal(x + x @ np.where(far, (s + values[None, :] * r) / np.where(far, values[None, :] - values[:, None], 1), r / 2))
        for span in (np.flatnonzero(number == i) for i in np.flatnonzero(np.bincount(number) > 1)):
            inside = x[:, span]
            small = inside.T @ (a @ inside) - values[span].mean() * (inside.T @ inside)
            small = (small + small.T) / 2
            if np.abs(small - np.diag(np.diag(small))).max() > eps * norm:
                x[:, span] = inside @ _turn(small)
    return kept


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, whose largest entry is positive."""
    size = float(np.abs(a).max()) if a.size else 0.0
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    # long double carries 64 bits on x86 and at least the 53 of a double elsewhere
    exact = (np.asarray(a, np.longdouble) + np.asarray(a, np.longdouble).T) / (2 * np.longdouble(size))
    _, start = np.linalg.eigh(exact.astype(np.float32))
    values, x = refine(exact, start.astype(np.longdouble))
    x = x / np.sqrt((x * x).sum(axis=0))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


# --- exact centring ------------------------------------------------------------------------------


class Model(NamedTuple):
    """Fit of the vectors of one length: their number, exact sums, and what places a vector."""

    n: int
    sums: list[int]
    turn: np.ndarray | None = None  # columns: eigenvectors over the roots of the eigenvalues; NaN without variance
    explained: list[float | None] | None = None
    identity_error: float | None = None


def spread(x: np.ndarray, model: Model) -> np.ndarray:
    """n * x - S in whole numbers, exact: 64 bits where they suffice, else Python's."""
    middle = [s // model.n for s in model.sums]
    rest = [s % model.n for s in model.sums]
    centre = np.array(middle, np.int64)
    reach = np.abs(x.astype(np.float64) - centre).max(initial=0.0) + 1
    kind = np.int64 if reach * model.n < 2.0**62 else object
    return (x.astype(kind) - centre.astype(kind)) * model.n - np.array(rest, kind)


def deviations(z: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; None beyond 64 bits."""
    bound = (z.astype(np.float64) ** 2).sum(axis=1)
    if z.dtype != object and bound.max(initial=0.0) < 2.0**62:
        return (z * z).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in z.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length, with their entries as a matrix."""
    for whole in batches:
        for batch in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
            lengths = np.array(batch.column("x").value_lengths())
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                yield dim, part, part.column("x").flatten().to_numpy().reshape(part.num_rows, dim)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sums of the vectors of a task; upper and lower halves apart, so that no sum overflows."""
    found: dict[int, list] = {}
    for dim, _, x in _by_length(batches):
        held = found.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
        held[0] += len(x)
        held[1] += (x >> 32).sum(axis=0)
        held[2] += (x & 0xFFFFFFFF).sum(axis=0)
    for dim, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)],
            ["dim", "i", "n", "high", "low"],
        )


def _products(models, turned: bool):
    """Sums over a task of products of centred entries, or of whitened ones with a one behind them; a row per entry."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for dim, _, x in _by_length(batches):
            model = models.value[dim]
            y = spread(x, model).astype(np.float64) / model.n
            if turned:
                y = np.column_stack([y @ model.turn, np.ones(len(y))])
            found[dim] = found.get(dim, 0) + y.T @ y
        for dim, products in found.items():
            yield _matrix_rows(dim, products)

    return rows


def _matrix_rows(dim: int, matrix: np.ndarray, index: np.ndarray | None = None) -> pa.RecordBatch:
    index = np.arange(len(matrix)) if index is None else index
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(matrix), dim)), pa.array(index), lists], ["dim", "i", "products"])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal rows of matrices; a task holds one copy of its rows."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for dim, i, products in zip(batch.column("dim").to_pylist(), batch.column("i").to_pylist(), batch.column("products")):
            found[dim, i] = found.get((dim, i), 0) + products.values.to_numpy()
    for (dim, i), products in found.items():
        yield _matrix_rows(dim, products[None, :], np.array([i]))


def _total(distinct: DataFrame, models: dict[int, Model], turned: bool) -> dict[int, np.ndarray]:
    """Matrix of summed products for each length; the driver holds the square of the length, whatever the rows."""
    kind = "dim long, i long, products array<double>"
    shared = distinct.sparkSession.sparkContext.broadcast(models)
    parts = distinct.mapInArrow(_products(shared, turned), kind).repartition("dim", "i").mapInArrow(_added, kind)
    found: dict[int, dict[int, list]] = {}
    for row in parts.collect():
        found.setdefault(row["dim"], {})[row["i"]] = row["products"]
    return {dim: np.array([lines[i] for i in range(len(lines))]) for dim, lines in found.items()}


def whole_numbers(vector: Column) -> Column:
    """The entries as whole numbers."""
    far = F.lit(FAR)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, far), -far)) + F.lit(SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vector in ``distinct`` (x), whose rows all differ."""
    number = F.col("high").cast("decimal(38,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("low")
    sums = (
        distinct.mapInArrow(_sums, "dim long, i long, n long, high long, low long")
        .groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(number.cast("decimal(38,0)")).alias("s")).orderBy("dim", "i").collect()
    )
    models: dict[int, Model] = {}
    for row in sums:
        models.setdefault(row["dim"], Model(row["n"], [])).sums.append(int(row["s"]))
    if not models:
        return models
    for dim, products in _total(distinct, models, False).items():
        covariance = products / models[dim].n
        values, vectors = eigen(covariance)
        trace = float(np.trace(covariance))
        kept = values[: min(components, dim)]
        real = kept > dim * np.finfo(np.float64).eps * max(trace, 0.0)  # else zero but for rounding
        roots = np.sqrt(np.where(real, kept, np.nan))
        explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in kept]
        models[dim] = models[dim]._replace(turn=vectors[:, : len(kept)] / roots, explained=explained)
    for dim, products in _total(distinct, models, True).items():
        n = models[dim].n
        means = products[-1, :-1] / n
        whitened = products[:-1, :-1] / n - np.outer(means, means)
        real = ~np.isnan(np.diag(whitened))
        off = np.abs(whitened[np.ix_(real, real)] - np.eye(int(real.sum())))
        models[dim] = models[dim]._replace(identity_error=float(off.max()) if off.size else None)
    return models


def _placed(models):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in _by_length(batches):
            model, size = models.value[dim], part.num_rows
            z = spread(x, model)
            y = (z.astype(np.float64) / model.n) @ model.turn
            flat = pa.array(y.ravel(), from_pandas=True)  # NaN, no variance to divide by, becomes NULL
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"), pa.array(np.full(size, dim)), pa.array(np.full(size, model.n)), pa.array(deviations(z), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * y.shape[1], pa.int32()), flat),
                    pa.array([model.explained] * size, pa.list_(pa.float64())), pa.array([model.identity_error] * size, pa.float64()),
                ],
                ["vec_id", "dim", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitens every vector by the covariance of the different vectors of its length.

    Entries become whole numbers x, see ``whole_numbers``; sums are exact, and
    equal vectors count once. Returns one row per usable row: vec_id, dim, n
    (different vectors), deviation (sum of (n * x - S)^2, exact; NULL beyond 64
    bits), whitened (array of up to ``components`` numbers), explained (share of
    the variance of each) and identity_error (largest distance of the covariance
    of the whitened vectors from the identity).

    Vectors that are NULL or hold NULL, NaN or infinite entries are dropped; of
    entries beyond 2**60 / 64 that bound is taken. Vectors of another length are a
    population of their own. A component without variance is NULL, as are shares
    of no variance at all; an empty vector has no components. Repeated rows and
    ids, and NULL ids, stay rows of their own; an empty table gives an empty
    result; other columns are not read.

    Matrices as wide as the vectors are added up by many tasks and solved in the
    driver; vectors themselves never leave the tasks.
    """
    usable_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    rows = usable_rows.select("vec_id", whole_numbers(F.col("v")).alias("x"))
    distinct = stored(rows.filter(F.size("x") > 0).select("x").distinct())
    models = fit(distinct, components) | {0: Model(1, [], np.zeros((0, 0)), [])}
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    return rows.mapInArrow(
        _placed(shared), "vec_id long, dim long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    )


def digest(whitened: DataFrame) -> DataFrame:
    """Rows of the registered query: one per vector and component."""
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), F.col("whitened").alias("w"), F.col("explained").alias("e")))
    return (
        whitened.filter(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", each.alias("c"))
        .select("vec_id", "c.component", "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), "identity_error")
    )
