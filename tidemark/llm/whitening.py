"""Whitening of embeddings by shifted CholeskyQR.

Entries become fixed-point integers, so that the mean is exact. The centred rows X are then orthogonalised without ever
being gathered: a pass over the data adds up the Gram matrix of X R^-1 (rows pass through triangular solves inside the tasks),
its Cholesky factor is composed onto R, and the next pass measures again. The first factor is shifted, so that it exists
however badly conditioned X is. Once the Gram matrix is the identity (or a projector, where dimensions depend on
each other), X has the right singular vectors of R, which is d x d. Only Gram matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries are clamped to this absolute value after scaling, so that sums of many of them stay exact.
LARGEST = 1 << 50
#: A Gram matrix is taken as orthogonal when no entry is farther off, and a direction as absent below ``_ABSENT``.
_ORTHOGONAL, _ABSENT = 1e-11, 1e-9


def fixed_point(vectors: pa.Array, dim: int, scale: int = 1024, offset: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list array are whole (``dim`` entries, all finite), and their entries as floor(scale * c) + offset."""
    whole = np.asarray(vectors.value_lengths().fill_null(-1)) == dim
    flat = vectors.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(flat).all(axis=1)
    whole[whole] = finite
    return whole, np.clip(np.floor(scale * flat[finite]), -LARGEST, LARGEST).astype(np.int64) + offset


def solve_right(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ... for upper triangular factors, by substitution over all rows at once.

    One solve after the other, since each factor is far better conditioned than their product.
    """
    out = rows.copy()
    for r in factors:
        for j in range(r.shape[0]):
            out[:, j] = (out[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


@dataclass(frozen=True)
class Whitening:
    dim: int
    n: int
    sums: tuple[int, ...]  # exact, by dimension
    axes: np.ndarray  # dim x components: unit eigenvectors
    values: np.ndarray  # their eigenvalues, falling
    trace: float
    identity_error: float | None  # of the whitened fit list, over components with variance

    def scaled(self) -> np.ndarray:
        """Axes over the root of their eigenvalue; NaN for those without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.axes / np.sqrt(self.values), np.nan)


def _centre(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x - S / n in double precision, and its exact parts: x - S // n and S mod n."""
    whole, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    near = x - whole
    return near - rest / n, near, rest


def _exact_sums(df: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Row count and sum of each dimension. Halves of 32 bits are added up apart, so that no sum overflows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            _, x = fixed_point(batch.column(0), dim)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], names=["k", "n", "high", "low"])

    parts = df.mapInArrow(sums, "k long, n long, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = sorted(parts.collect())  # one row a dimension
    return (found[0]["n"] if found else 0), tuple((r["high"] << 32) + r["low"] for r in found)


def _gram(df: DataFrame, dim: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Gram matrix of ``rows_of(x)`` over all rows: each task adds up its own, Spark adds up the tasks' entries."""
    above = np.triu_indices(width)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = rows_of(fixed_point(batch.column(0), dim)[1])
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(above[0]))), pa.array(total[above])], names=["k", "v"])

    found = df.mapInArrow(grams, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # bounded by the dimension
    out = np.zeros((width, width))
    for r in found:
        i, j = above[0][r["k"]], above[1][r["k"]]
        out[i, j] = out[j, i] = r["v"]
    return out


def fit_whitening(df: DataFrame, vec_col: str = "embedding", components: int = 8, passes: int = 12) -> Whitening:
    """Whitening of all rows' fixed-point vectors, to double precision.

    The dimension is the most frequent length of a vector (of ties the largest); rows of other lengths lack entries and
    do not count, like null vectors and those with null or non-finite entries. Raises if ``passes`` do not
    orthogonalise the rows. Directions without variance get eigenvalue 0.
    """
    vectors = df.select(F.col(vec_col).cast("array<double>").alias("v"))
    lengths = vectors.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    n, sums = _exact_sums(vectors, dim) if dim else (0, ())
    components = min(components, dim)
    if not n:
        return Whitening(dim, 0, sums, np.zeros((dim, components)), np.zeros(components), 0.0, None)
    factors, factor, trace = [], np.eye(dim), 0.0
    for step in range(passes):
        gram = _gram(vectors, dim, lambda x, rs=tuple(factors): solve_right(_centre(x, n, sums)[0], rs), dim)
        if step == 0:
            trace = float(np.trace(gram))
            if trace == 0:
                return Whitening(dim, n, sums, np.eye(dim)[:, :components], np.zeros(components), 0.0, None)
            shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * trace
            factors.append(np.linalg.cholesky(gram + shift * np.eye(dim)).T)
            factor = factors[0]
            continue
        value, vector = np.linalg.eigh(gram)
        absent = vector[:, value < _ABSENT]
        filled = gram + absent @ absent.T  # the identity on directions that the rows do not have
        root = vector * np.sqrt(np.where(value < _ABSENT, 0, value)) @ vector.T
        if np.abs(filled - np.eye(dim)).max() < _ORTHOGONAL:
            break
        factors.append(np.linalg.cholesky(filled).T)
        factor = factors[-1] @ factor
    else:
        raise ValueError(f"rows are not orthogonal after {passes} passes")
    _, single, right = np.linalg.svd(root @ factor)
    values = np.where(single > single[0] * dim * np.finfo(float).eps * 8, single**2 / n, 0.0)[:components]
    found = Whitening(dim, n, sums, right[:components].T, values, trace / n, None)
    scaled = found.scaled()[:, values > 0]
    seen = _gram(vectors, dim, lambda x: np.hstack([(z := _centre(x, n, sums)[0] @ scaled), np.ones((len(z), 1))]), scaled.shape[1] + 1) / n
    covariance = seen[:-1, :-1] - np.outer(seen[:-1, -1], seen[:-1, -1])
    return Whitening(dim, n, sums, found.axes, values, trace / n, float(np.abs(covariance - np.eye(len(covariance))).max()))


def whiten(df: DataFrame, fit: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each whole vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows that ``fit_whitening`` leaves out are left out. ``deviation`` is the exact sum over dimensions of (n x - S)^2 as
    decimal(38, 0), null beyond its range. Components without variance have whitened null and explained 0. Rows
    that repeat an id stay rows of their own; null ids stay null; other columns are ignored; an empty input gives no rows.
    Entries beyond 2^50 / 1024 count as that.
    """
    count = fit.axes.shape[1]
    scaled = fit.scaled()
    explained = fit.values / fit.trace if fit.trace else np.zeros(count)
    kind = pa.decimal128(38, 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x = fixed_point(batch.column(1), fit.dim)
            if not len(x):
                continue
            centred, near, rest = _centre(x, fit.n, fit.sums)
            reach = fit.n * (int(np.abs(near).max()) + 1)
            if reach < 1 << 31 and reach * reach * fit.dim < 1 << 63:
                deviation = pa.array(((fit.n * near - rest) ** 2).sum(axis=1)).cast(kind)
            else:
                exact = ((fit.n * near.astype(object) - rest) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], kind)
            every = np.repeat(np.arange(len(x)), count)
            z = (centred @ scaled).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).filter(pa.array(whole)).take(pa.array(every)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(every), fit.n)), deviation.take(pa.array(every)), pa.array(z, mask=np.isnan(z)),
                pa.array(np.tile(explained, len(x))), pa.array([fit.identity_error] * len(every), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    given = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.lit(fit.n > 0))
    return given.mapInArrow(rows, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``; deviation is null where it does not fit 64 bits."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(df, fit_whitening(df)).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
