"""Whitening of embeddings, with covariances by polarisation.

Entries become integers, so every sum is exact. Over the fit list (each distinct vector
once) Spark aggregates the squared centred values of every dimension and of the sum of every
two dimensions. Half of what the variance of a sum exceeds the two variances by is the
covariance: ``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``. So d(d+1)/2 sums, one row each,
give the whole matrix, however many vectors there are; its eigenvectors come from ``eigh``.

Values are centred by the whole part of the mean, kept as integers, and what remains of the mean
is taken off exactly: with ``y`` so centred and ``s`` the sum of y, the squares of ``n y - s``
sum up to ``n (n sum(y*y) - s*s)``. Where 64 bits might not do, Python's integers take over.

Cases: rows whose vector is null or holds null or non-finite entries, or entries that no
64-bit integer can hold when scaled, are left out. So are vectors of no entry, and vectors of
another length than most have (of equally frequent lengths the longest counts). Null or repeated ids are ordinary, and so
are repeated vectors: each row gets its result, the fit list holds the vector once. Components
without variance are left out: with fewer distinct vectors than dimensions, or equal ones,
there are fewer of them, or none. An empty table gives an empty result. Other columns are left out. ``deviation`` is
null where 64 bits cannot hold it. Vectors of any length are read whole; the matrix is held
by the driver, so the length is meant to be some thousands at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: entries are multiplied by the scale, rounded down, and moved by the shift
SCALE, SHIFT = 64, 1_000_000
#: scaled entries from here on could leave 64 bits
LARGEST = float(2**61)
#: an eigenvalue below this share of the largest, for each dimension, counts as none
NOTHING = 2.0**-50
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, the sums of its entries, and the components."""

    n: int
    sums: tuple[int, ...]
    #: unit eigenvectors, one a row, by falling eigenvalue
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def integers(vector: Column) -> Column:
    """The whole numbers that stand for a vector's entries."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id`` and ``x`` (whole numbers) of the rows that can be used."""
    good = F.forall(F.col("v"), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST / SCALE))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("v"))
    rows = rows.where((F.size("v") > 0) & good)
    return rows.select("_id", integers(F.col("v")).alias("x"))


def _matrix(column) -> np.ndarray:
    """The rows of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _wide(a: np.ndarray, largest: int, rows: int = 1) -> np.ndarray:
    """The array itself, or with Python's integers if sums of squares might pass 63 bits."""
    return a if largest * largest * max(rows, 1) < 1 << 62 else a.astype(object)


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def _column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of every dimension."""

    def add(batches):
        import pyarrow as pa

        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n += len(x)
                part = np.array([int(v) for v in _wide(x, _largest(x), len(x)).sum(axis=0)], object)
                sums = part if sums is None else sums + part
        if n:
            dimensions = pa.array(range(len(sums)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(sums)), dimensions, pa.array([str(v) for v in sums])], ["n", "i", "total"]
            )

    parts = fit.select("x").mapInArrow(add, "n long, i int, total string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: r for r in rows.collect()}  # one row a dimension
    return (found[0]["n"] if found else 0), [int(found[i]["total"]) for i in range(len(found))]


def pair_squares(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of squares of centred values: ``(i, i)`` of a dimension, ``(i, j)`` of two added up."""
    middle, d = np.array(centre, np.int64), len(centre)

    def add(batches):
        import pyarrow as pa

        totals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(0)) - middle
            y = np.asfortranarray(_wide(y, 2 * _largest(y), len(y)))
            part = []
            for i in range(d):
                part.append((y[:, i] ** 2).sum())
                both = y[:, i : i + 1] + y[:, i + 1 :]
                part += (both * both).sum(axis=0).tolist()
            part = np.array([int(v) for v in part], object)
            totals = part if totals is None else totals + part
        if totals is not None:
            pairs = [(i, j) for i in range(d) for j in range(i, d)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()),
                 pa.array([str(v) for v in totals])],
                ["i", "j", "total"],
            )

    parts = fit.select("x").mapInArrow(add, "i int, j int, total string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in rows.collect()}  # d(d+1)/2 rows


def covariance(n: int, s: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix (divisor n) from sums ``s`` and squares of values centred alike."""
    d = len(s)
    spread = [n * squares[i, i] - s[i] * s[i] for i in range(d)]  # n*n times the variance
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = spread[i] / (n * n)
        for j in range(i + 1, d):
            both = n * squares[i, j] - (s[i] + s[j]) ** 2
            v[i, j] = v[j, i] = (both - spread[i] - spread[j]) / (2 * n * n)
    return v


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of some vectors, one column a component."""
    n, sums = model.n, model.sums
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (((x - whole).astype(float) - rest) @ model.axes.T) / np.sqrt(model.values)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, at most."""
    k = len(model.values)
    if not k:
        return 0.0

    def add(batches):
        import pyarrow as pa

        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(_matrix(batch.column(0)), model)
                total += w.sum(axis=0)
                products += w.T @ w
        values = np.concatenate((total, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

    rows = fit.select("x").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(k + k * k)
    for r in rows:
        values[r["i"]] = r["v"] / model.n
    # whitened values are centred; what rounding left of their mean is taken off
    return float(np.abs(values[k:].reshape(k, k) - np.outer(values[:k], values[:k]) - np.eye(k)).max())


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening:
    """The whitening of a table of distinct integer vectors ``x`` of one length."""
    n, sums = _column_sums(fit)
    if not n:
        return Whitening(0, (), np.empty((0, 0)), np.empty(0), 0.0, 0.0)
    centre = [s // n for s in sums]
    v = covariance(n, [s - n * c for s, c in zip(sums, centre)], pair_squares(fit, centre))
    values, axes = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    kept = order[values[order] > max(values.max(), 0) * len(v) * NOTHING]
    model = Whitening(n, tuple(sums), np.ascontiguousarray(axes[:, kept].T), values[kept], float(np.trace(v)), 0.0)
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(fit, model)})


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``_id`` and the coordinates of every row, one row a component."""
    k, n = len(model.values), model.n

    def run(batches):
        import pyarrow as pa

        if not k:
            return
        whole = np.array([s // n for s in model.sums], np.int64)
        rest = np.array([s % n for s in model.sums], np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                x = _matrix(some.column(1))
                y = x - whole
                far = n * (_largest(y) + 1)
                y = y * n - rest if far * far * len(whole) < 1 << 62 else y.astype(object) * n - rest.astype(object)
                deviation = [int(v) for v in (y * y).sum(axis=1)]
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()).take(
                            pa.array(np.repeat(np.arange(m), k))
                        ),
                        pa.array(projected(x, model).ravel()),
                        pa.array(np.tile(model.values / model.trace, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "x").mapInArrow(run, f"_id {kind}, {RESULT}")


def whiten(
    vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The id and, one row a component, ``component, n, deviation, whitened, explained, identity_error``."""
    rows = usable(vectors, id_col, vec_col)
    # one row for each length that occurs
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (lengths["d"] if lengths else 0))
    fit = save(rows.select("x").distinct(), "whitening-fit")
    return whitened(rows, fit_whitening(fit, components)).withColumnRenamed("_id", id_col)
