"""Embedding whitening by polarisation: covariances out of variances of single dimensions and of sums of two.

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2

Entries are whole numbers, so nothing is rounded before the eigenvectors: with n vectors and sums S the centred value of a
dimension is (n*x - S) / n, and Spark adds up the exact squares of n*x - S for every dimension and every sum of two. A task
reduces its batches to one number per pair, those are added as ``decimal(38, 0)``, and only the d*(d+1)/2 totals reach
the driver, which assembles the matrix and takes ``eigh`` of it. The fit list is every distinct vector once: copies are
combined in the map tasks before they are shuffled, so a vector that a third of the rows share costs nothing more.

Rows whose vector is null, empty or holds an entry that is null or not finite are left out; other columns may be null.
Repeated rows are whitened one by one and count once in the fit. Without usable rows the result is empty. A component
that has no variance (one distinct vector, dimensions that depend on each other) has ``whitened`` null. Vectors of
unequal length are an error, and so are more than ``MAX_DIMENSIONS`` entries, whose pairs are not for a driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm.store import materialize, table
from folioscope.llm.vectors import is_vector, matrix, one_dimension, whole_numbers

COMPONENTS = 4
MAX_DIMENSIONS = 2_048
#: Squares are added in two limbs of this many bits, ``LIMB_ROWS`` rows at a time, which a 64-bit number holds.
LIMB = 24
LIMB_ROWS = 1 << 14


@dataclass(frozen=True)
class Whitener:
    """What the fit list gives: count, sums per dimension, eigenvectors as columns and their eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance beyond what rounding alone makes."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of whole-number rows; NaN for a component without variance."""
        # Subtracting the whole part of the mean first keeps small entries exact however large n is.
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([(s - int(w) * self.n) / self.n for s, w in zip(self.sums, whole)])
        with np.errstate(invalid="ignore", divide="ignore"):
            out = ((x - whole) - rest) @ self.vectors / np.sqrt(np.where(self.usable, self.values, np.nan))
        return out


def fit_list(rows: DataFrame, column: str = "x") -> DataFrame:
    """Every distinct vector once."""
    return rows.select(column).distinct()


def _squares(v: np.ndarray) -> list[int]:
    """Exact sums of squares by column."""
    reach = int(max(v.max(initial=0), -v.min(initial=0)))
    if len(v) * reach * reach < 1 << 62:
        return np.einsum("ij,ij->j", v, v).tolist()
    if reach >= 1 << (2 * LIMB):
        return [sum(y * y for y in column) for column in v.T.tolist()]
    total = [0] * v.shape[1]
    for lo in range(0, len(v), LIMB_ROWS):
        part = v[lo:lo + LIMB_ROWS]
        high, low = part >> LIMB, part & ((1 << LIMB) - 1)
        hh, hl, ll = (np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
        total = [t + (a << (2 * LIMB)) + (b << (LIMB + 1)) + c for t, a, b, c in zip(total, hh, hl, ll)]
    return total


def _totals(batches: Iterator[pa.RecordBatch], names: list[str], add) -> Iterator[pa.RecordBatch]:
    """One row (key, value) per total that ``add`` keeps over the batches of a task."""
    total: dict = {}
    for batch in batches:
        for key, value in add(batch):
            total[key] = total.get(key, 0) + value
    if total:
        from decimal import Context, Decimal

        exact = Context(prec=80)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([exact.create_decimal(Decimal(v)) for v in total.values()], pa.decimal128(38, 0))], names=names)


def _column_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    def sums(batches):
        def add(batch):
            x = matrix(batch.column("x"), dim)
            high, low = x >> 32, x & 0xFFFFFFFF
            yield -1, len(x)
            yield from enumerate((h << 32) + l for h, l in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist()))

        return _totals(batches, ["k", "v"], add)

    rows = {r.k: int(r.v) for r in fit.mapInArrow(sums, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return rows.pop(-1, 0), [rows[i] for i in range(dim)] if rows else []


def polarised(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """(a, b) -> exact sum of squares of the centred values of dimension a (where a = b), or of the sum of a and b, times n squared."""
    dim = len(sums)

    def squares(batches):
        shift = np.array(sums, object)
        small = n * max(1, max(map(abs, sums))) < 1 << 61

        def add(batch):
            x = matrix(batch.column("x"), dim)
            reach = int(max(x.max(initial=0), -x.min(initial=0)))
            if small and n * reach < 1 << 60:
                z = x * n - shift.astype(np.int64)
            else:
                z = x.astype(object) * n - shift
            for a in range(dim):
                pairs = z[:, a:a + 1] + z[:, a:]
                pairs[:, 0] = z[:, a]
                found = _squares(pairs) if z.dtype != object else [sum(y * y for y in c) for c in pairs.T.tolist()]
                for b, value in enumerate(found, a):
                    yield a * dim + b, value

        return _totals(batches, ["k", "v"], add)

    added = fit.mapInArrow(squares, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return {divmod(r.k, dim): int(r.v) for r in added}


def covariance(squares: dict[tuple[int, int], int], n: int, dim: int) -> np.ndarray:
    """The matrix, each entry one rounding away from its exact value."""
    cov = np.zeros((dim, dim))
    for (a, b), s in squares.items():
        cov[a, b] = cov[b, a] = s / n**3 if a == b else (s - squares[a, a] - squares[b, b]) / (2 * n**3)
    return cov


def fit(vectors: DataFrame, components: int | None = None) -> Whitener | None:
    """Whitener of distinct vectors in column ``x``; None without any."""
    dim = one_dimension(vectors, "x")
    if dim > MAX_DIMENSIONS:
        raise ValueError(f"{dim} dimensions are more than {MAX_DIMENSIONS}")
    n, sums = _column_sums(vectors, dim)
    if not n:
        return None
    cov = covariance(polarised(vectors, n, sums), n, dim)
    values, eigen = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitener(n, tuple(sums), eigen[:, order], values[order], float(np.trace(cov)))


def identity_error(vectors: DataFrame, w: Whitener) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity), over the components that have a variance."""
    dim, use = len(w.sums), np.flatnonzero(w.usable)
    if not len(use):
        return None

    def moments(batches):
        sums, products = np.zeros(len(use)), np.zeros((len(use), len(use)))
        for batch in batches:
            y = w.project(matrix(batch.column("x"), dim))[:, use]  # centred: the mean is taken off before
            sums += y.sum(axis=0)
            products += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(use) * (len(use) + 1))), pa.array(np.append(sums, products.ravel()))], names=["k", "v"])

    rows = {r.k: r.v for r in vectors.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([rows[i] for i in range(len(rows))])
    mean, products = flat[:len(use)] / w.n, flat[len(use):].reshape(len(use), len(use)) / w.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(len(use))).max())


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and whole-number vector ``x`` of the rows that have one."""
    return embeddings.where(is_vector(F.col(vec_col))).select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vec_col)).alias("x"))


def whiten(rows: DataFrame, w: Whitener) -> DataFrame:
    """``rows`` (vec_id, x) with ``deviation`` (exact, long) and ``whitened``, one value a component."""
    dim = len(w.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array(w.sums, object)
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            reach = max(int(max(x.max(initial=0), -x.min(initial=0))) * w.n, max(map(abs, w.sums)))
            if dim * 4 * reach * reach < 1 << 63:
                z = x * w.n - shift.astype(np.int64)
                deviation = np.einsum("ij,ij->i", z, z).tolist()
            else:
                deviation = [sum(y * y for y in row) for row in (x.astype(object) * w.n - shift).tolist()]
            y = w.project(x)
            flat = pa.array(y.ravel(), mask=np.isnan(y).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), flat)],
                names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(project, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op13_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    vectors = materialize(fit_list(rows), "distinct-vectors")
    w = fit(vectors, COMPONENTS)
    if w is None:
        return spark.createDataFrame([], RESULT)
    error = identity_error(vectors, w)
    share = [float(v / w.trace) if w.trace > 0 else None for v in w.values]
    return whiten(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened")).select(
        "vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*(F.lit(s).cast("double") for s in share)), F.col("_i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def brute_force(rows: list[tuple], components: int = COMPONENTS) -> list[tuple]:
    """vec_id, component, n, deviation, |whitened|, explained from the definition, in exact fractions up to ``eigh``; for tests."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, [floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    unique = sorted({tuple(x) for _, x in kept})
    if not unique:
        return []
    n, dim = len(unique), len(unique[0])
    mean = [Fraction(sum(x[k] for x in unique), n) for k in range(dim)]
    cov = np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in unique) / n) for b in range(dim)] for a in range(dim)])
    values, eigen = np.linalg.eigh(cov)
    values, eigen = values[::-1], eigen[:, ::-1]
    out = []
    for i, x in kept:
        centred = [x[k] - mean[k] for k in range(dim)]
        deviation = int(sum((n * c) ** 2 for c in centred))
        for k in range(min(components, dim)):
            flat = values[k] <= values.sum() * dim * np.finfo(float).eps
            y = None if flat else abs(float(np.dot([float(c) for c in centred], eigen[:, k]) / values[k] ** 0.5))
            out.append((i, k + 1, n, deviation, y, values[k] / values.sum() if values.sum() > 0 else None))
    return out
