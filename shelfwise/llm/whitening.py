"""Op 12: whitening of embeddings by principal components to double precision.

Entries c become whole numbers x = floor(1024 c) + 100000.  Sums and products of
whole numbers are exact, in any order, so every run on any cluster fits the same
covariance: sums per dimension, then products of the entries centred at the whole
number nearest to the mean; the rest of the mean is taken off the exact totals.

The eigenvectors of the covariance start as those of its float32 form and are
corrected by the Ogita-Aishima iteration, matrix products in extended precision:
with R = I - X'X, S = X'AX and l_i = S_ii / (1 - R_ii), X gains X E, where
E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where l_i and l_j lie too close
for that.  Such a cluster is solved by itself, as the small matrix X_J'(A - mI)X_J
with m in its middle, which shows differences that the whole matrix hides.

Defined cases: a row whose vector is null, or has a null or non-finite entry (or one
whose x is no long), is dropped; so is one whose length is not the most frequent one
(ties: the longer).  Null and repeated ids are rows like any; extra columns are
ignored; an empty table gives an empty result.  A component without variance has a
null ``whitened`` and takes no part in the identity error.  A deviation beyond a
long is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_BITS = 20                  # of a limb: products of 4,096 rows stay whole numbers in a double
_ROWS = 4096
_HALF = 32                  # bits of the low half of a total
_LARGEST = float(1 << 62)
_MOST_STEPS = 30

LD = np.longdouble


def whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that remain, and their vectors as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    size = np.where(np.isnan(size), 0, size).astype(np.int64) if size.dtype.kind == "f" else size
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(size) - size
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (size == dim)
    rows = np.flatnonzero(valid)
    vectors = flat[first[rows][:, None] + np.arange(dim)] * SCALE
    with np.errstate(invalid="ignore"):
        good = (np.abs(vectors) < _LARGEST).all(axis=1)         # false for NaN, which a null is, too
    return rows[good], np.floor(vectors[good]).astype(np.int64) + SHIFT


def _halves(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return total >> _HALF, total & ((1 << _HALF) - 1)


def _exact(high: list[int], low: list[int]) -> list[int]:
    return [(int(h) << _HALF) + int(v) for h, v in zip(high, low)]


def _totals(rows: DataFrame, extra: list) -> list:
    """Sums per position of the arrays ``high`` and ``low`` of each task."""
    return rows.select("n", "least", "most", F.posexplode(F.arrays_zip("high", "low"))).groupBy("pos").agg(
        F.sum("col.high").alias("high"), F.sum("col.low").alias("low"), *extra).orderBy("pos").collect()


_TASK = "n long, least long, most long, high array<long>, low array<long>"


def _task_row(n: int, least: int, most: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([n], pa.int64()), pa.array([least], pa.int64()), pa.array([most], pa.int64()),
        pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))],
        names=["n", "least", "most", "high", "low"])


def fit_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int], int, int]:
    """Rows that remain, sums of each dimension, least and largest entry."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        least, most = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        for batch in batches:
            _, x = whole_numbers(batch.column(1), dim)
            if len(x):
                h, v = _halves(x)
                n, high, low = n + len(x), high + h.sum(axis=0), low + v.sum(axis=0)
                least, most = min(least, int(x.min())), max(most, int(x.max()))
        if n:
            yield _task_row(n, least, most, high, low)

    found = _totals(vectors.mapInArrow(run, _TASK), [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")])
    if not found:
        return 0, [0] * dim, 0, 0
    return found[0].n, _exact([r.high for r in found], [r.low for r in found]), found[0].least, found[0].most


def limbs(y: np.ndarray, count: int) -> np.ndarray:
    """Columns of whole numbers side by side, as ``count`` limbs of ``_BITS`` bits each."""
    parts = [(y >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(count - 1)] + [y >> (_BITS * (count - 1))]
    return np.hstack(parts).astype(np.float64)


def fit_products(vectors: DataFrame, dim: int, centre: list[int], count: int) -> list[list[int]]:
    """Exact sums of the products of centred entries, from ``count`` limbs each."""
    wide = dim * count
    above = np.triu_indices(wide)
    at = np.array(centre, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(len(above[0]), np.int64), np.zeros(len(above[0]), np.int64), 0
        for batch in batches:
            _, x = whole_numbers(batch.column(1), dim)
            for i in range(0, len(x), _ROWS):
                z = limbs(x[i:i + _ROWS] - at, count)
                h, v = _halves((z.T @ z)[above].astype(np.int64))
                high, low, n = high + h, low + v, n + len(z)
        if n:
            yield _task_row(n, 0, 0, high, low)

    found = _totals(vectors.mapInArrow(run, _TASK), [])
    total = [[0] * dim for _ in range(dim)]
    for i, j, value in zip(*above, _exact([r.high for r in found], [r.low for r in found])):
        (a, p), (b, q) = divmod(int(i), dim), divmod(int(j), dim)
        value <<= _BITS * (a + b)
        total[p][q] += value
        if i != j:
            total[q][p] += value
    return total


def _long_double(x: Fraction) -> np.longdouble:
    high = float(x)
    return LD(high) + LD(float(x - Fraction(high)))


def covariance(n: int, rest: list[int], products: list[list[int]]) -> np.ndarray:
    """Covariance, divisor n, from exact sums and products of centred entries."""
    return np.array([[_long_double(Fraction(n * v - a * b, n * n)) for v, b in zip(row, rest)]
                     for row, a in zip(products, rest)], dtype=LD).reshape(len(rest), len(rest))


def _norm(a: np.ndarray) -> np.longdouble:
    return np.sqrt((a * a).sum())


def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Positions of values that a chain of gaps of at most ``gap`` links."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return np.split(order, cuts)


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; largest entry positive)
    of a symmetric matrix in extended precision."""
    size = len(a)
    scale = np.abs(a).max() if size else LD(0)
    if not size or scale == 0:
        return np.zeros(size, LD), np.eye(size, dtype=LD)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x, eye, tiny = start.astype(LD), np.eye(size, dtype=LD), np.finfo(LD).eps * size
    whole, last = _norm(a), LD(np.inf)
    for _ in range(_MOST_STEPS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        # Below the second bound rounding alone would make E large, and its square a loss of orthogonality.
        gap = max(2 * (_norm(off) + whole * _norm(r)), whole * size * np.sqrt(np.finfo(LD).eps))
        groups = _clusters(values, gap)
        group = np.empty(size, dtype=np.int64)
        for k, members in enumerate(groups):
            group[members] = k
        apart = group[:, None] != group[None, :]
        below = np.where(apart, values[None, :] - values[:, None], 1)
        e = np.where(apart, (s + values[None, :] * r) / below, r / 2)
        x = x + x @ e
        change = np.abs(e).max()
        solved = False
        for members in groups:
            if len(members) > 1:
                own = x[:, members]
                middle = values[members].mean()
                small = own.T @ (a @ own - middle * own)
                small = (small + small.T) / 2
                rest = np.abs(small - np.diag(np.diag(small))).max()
                if rest > 4 * tiny * whole:                     # else the values are equal as far as can be told
                    _, turn = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))
                    x[:, members] = own @ turn.astype(LD)
                    solved = True
        if not solved and (change <= 4 * tiny or (change >= last and change < LD(1e-15))):
            break
        last = change
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((x * (a @ x)).sum(axis=0)) * scale
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(size)] < 0, LD(-1), LD(1))


@dataclass
class Whitening:
    """A fitted list of vectors; ``vectors`` are unit columns, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int = 0            # of all entries, without sign

    @property
    def dim(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """x - S/n, and the sum of (n x - S)^2 (null beyond a long)."""
        if self.largest * self.n < 1 << 61:
            d = x * self.n - np.array(self.sums, dtype=np.int64)
            off = d.astype(np.float64) / self.n
        else:
            d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
            off = np.array([[float(Fraction(v, self.n)) for v in row] for row in d], dtype=np.float64).reshape(x.shape)
        rough = (d.astype(np.float64) ** 2).sum(axis=1)
        if (rough < _LARGEST).all():
            d = d.astype(np.int64)
            return off, pa.array((d * d).sum(axis=1), pa.int64())
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return off, pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def weights(self, components: int) -> np.ndarray:
        """Columns that turn x - S/n into whitened components; NaN without variance."""
        k = min(components, self.dim)
        least = self.dim * np.finfo(np.float64).eps * (self.values[0] if self.dim else 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values[:k] > least, self.vectors[:, :k] / np.sqrt(np.abs(self.values[:k])), np.nan).astype(np.float64)


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def fit(vectors: DataFrame) -> Whitening:
    """Fit on ``vector`` of all rows: three passes, each one row a task."""
    sizes = vectors.filter("vector is not null").groupBy(F.size("vector").alias("dim")).count() \
        .orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = sizes[0].dim if sizes else 0
    if not dim:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums, least, most = fit_sums(vectors, dim)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    widest = max(max(most - c, c - least) for c in centre)
    products = fit_products(vectors, dim, centre, max(1, -(-(widest.bit_length() + 1) // _BITS)))
    v = covariance(n, [s - n * c for s, c in zip(sums, centre)], products)
    values, columns = eigenpairs(v)
    return Whitening(n, sums, values, columns, float(np.trace(v)), max(abs(least), abs(most)))


def transform(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``deviation`` and the list ``whitened`` of each remaining row."""
    weights, dim = model.weights(components), model.dim
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_numbers(batch.column(1), dim)
            off, deviation = model.deviations(x)
            white = off @ weights
            flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviation, lists], schema=schema)

    return vectors.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    columns = [F.col("whitened")[k] for k in range(components)]
    means = white.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    have = [k for k in range(components) if means[k] is not None]
    if not have:
        return None
    centred = {k: columns[k] - F.lit(means[k]) for k in have}
    found = white.agg(*[F.avg(centred[a] * centred[b]).alias(f"v{a}_{b}") for a in have for b in have if a <= b]).first()
    return max(abs(found[f"v{a}_{b}"] - (a == b)) for a in have for b in have if a <= b)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of ``table`` and component: vec_id, component,
    n, deviation, whitened, explained, identity_error (see the contract above)."""
    spark, vectors = table.sparkSession, _vectors(table, id_col, vector_col)
    model = fit(vectors)
    k = min(components, model.dim)
    if not model.n or not k:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    white = stored(transform(vectors, model, components), "whitened")
    error = identity_error(white, k)
    share = F.array(*[F.lit(float(v) / model.trace if model.trace else None).cast("double") for v in model.values[:k]])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
