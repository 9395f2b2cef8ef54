"""Whitened embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The matrix X holds one centred row for each distinct vector.  A step of the
bidiagonalisation is one Spark job over the rows: each task multiplies its rows
with the current right vector (Xv) and the result with its rows again (X'u),
and only sums as long as a vector leave it.  Left vectors are never stored: as
combinations of the columns of X, u = Xp, every task makes its part of them
anew from the small matrix of the p, also for the full reorthogonalisation.
The driver keeps right vectors and a small bidiagonal matrix, whose singular
values give components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridict.llm.tables import forget, written

#: Vector entries are counted in steps of 1 / SCALE, from -OFFSET / SCALE.
SCALE, OFFSET = 64, 1_000_000
#: Residual, relative to the largest singular value, at which a component counts as found.
CONVERGED = 1e-15
#: Directions with less than this part of the largest deviation count as none.
NO_DEVIATION = 1e-10
#: Numbers of a matrix that a task works on at a time.
BLOCK = 1 << 20


@dataclass
class Whitening:
    """Fitted on ``n`` distinct vectors with sums ``totals``: unit ``components`` as columns, their ``eigenvalues`` falling.

    ``explained`` are parts of the whole variance, ``identity_error`` is the
    largest entry of the whitened vectors' covariance minus the identity.
    """

    n: int
    totals: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int = 0

    @property
    def dim(self) -> int:
        return len(self.totals)


def _usable(vector: str):
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def dimension(vectors: DataFrame, vector: str = "embedding") -> int:
    """The length that most usable vectors have, of two equally frequent ones the longer; 0 without any."""
    lengths = vectors.where(_usable(vector)).groupBy(F.size(vector).alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most else 0


def _grid(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dim`` finite entries, and these as whole steps."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    c = flat.reshape(len(rows), dim)
    finite = np.isfinite(c).all(axis=1)
    steps = np.floor(SCALE * c[finite])
    if steps.size and np.abs(steps).max() >= 2.0**53:
        raise ValueError("an entry is too large to be counted in steps")
    return rows[finite], steps.astype(np.int64) + OFFSET


def distinct_vectors(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Each distinct usable vector once, as whole steps in ``x``; combined before the shuffle, so a hot vector costs a row a task."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _grid(batch.column(0), dim)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.record_batch([pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["x"])

    return vectors.select(F.col(vector).alias("v")).mapInArrow(steps, "x array<bigint>").distinct()


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        rows = max(1, BLOCK // dim)
        for a in range(0, len(x), rows):
            yield x[a : a + rows]


def _summed(fit: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum of ``part`` over all blocks of the rows: a few numbers a task, added up by Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, dim):
            own = part(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    rows = fit.mapInArrow(sums, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def _centred(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """x minus the mean, rounded once: whole numbers are subtracted before the division."""
    return (n * x - totals) / n


def _new_direction(rng: np.random.Generator, found: np.ndarray) -> np.ndarray:
    v = rng.standard_normal(found.shape[0])
    for _ in range(3):
        v -= found @ (found.T @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(fit: DataFrame, n: int, totals: np.ndarray, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Singular values (falling) and right vectors of the centred rows, with their sum of squares and the steps taken.

    Ends when ``wanted`` vectors have converged and what the found values leave
    of the sum of squares is less than the last wanted one, so that no repeated
    value can be missing; at the latest after as many steps as dimensions.
    Where the Krylov space is exhausted it goes on with a new direction.
    """
    d, rng = len(totals), np.random.default_rng(seed)
    right, combos, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas = [], []
    v, beta, scale, energy = _new_direction(rng, right), 0.0, 0.0, 0.0
    for k in range(1, d + 1):
        right = np.column_stack([right, v])
        q = v - beta * combos[:, -1] if k > 1 else v
        for _ in range(2):

            def part(x: np.ndarray, q: np.ndarray = q, combos: np.ndarray = combos) -> np.ndarray:
                xc = _centred(x, n, totals)
                w = xc @ q
                return np.concatenate([[w @ w, (xc * xc).sum()], xc.T @ w, (xc @ combos).T @ w])

            sums = _summed(fit, d, part, "double")
            square, energy, y, overlap = sums[0], sums[1], sums[2 : 2 + d], sums[2 + d :]
            if overlap @ overlap <= 1e-8 * square:
                break
            q = q - combos @ overlap
        scale = max(scale, np.sqrt(energy))
        alpha = np.sqrt(max(square - overlap @ overlap, 0.0))
        if alpha <= 1e-14 * scale:
            alpha, p, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, z = (q - combos @ overlap) / alpha, (y - back @ overlap) / alpha
        combos, back = np.column_stack([combos, p]), np.column_stack([back, z])
        alphas.append(alpha)
        rest = z - alpha * v
        for _ in range(2):
            rest -= right @ (right.T @ rest)
        beta = np.linalg.norm(rest)
        left, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        residuals = beta * np.abs(left[-1, :wanted])
        missing = energy - (values**2).sum()
        if k >= wanted and residuals.max() <= CONVERGED * values[0] and missing < values[wanted - 1] ** 2:
            break
        if k < d:
            if beta <= 1e-14 * scale:
                v, beta = _new_direction(rng, right), 0.0
            else:
                v = rest / beta
            betas.append(beta)
    return values, right @ turned.T, float(energy), k


def fit(vectors: DataFrame, components: int = 16, vector: str = "embedding") -> Whitening:
    """Principal directions of the distinct usable vectors, by falling eigenvalue of their covariance (divisor n).

    A vector is usable if it is not null, holds no null and no entry that is
    not finite, and has the length that most such vectors have.  There are
    fewer components than asked for where the vectors have fewer directions,
    and none for an empty table, one distinct vector or vectors without entries.
    """
    dim = dimension(vectors, vector)
    none = Whitening(0, np.zeros(dim, np.int64), np.zeros((dim, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not dim:
        return none
    rows = written(distinct_vectors(vectors, dim, vector))
    sums = _summed(rows, dim, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "bigint").astype(np.int64)
    n, totals = int(sums[0]), sums[1:]
    model = Whitening(n, totals, none.components, none.eigenvalues, none.explained, 0.0)
    if n > 1:
        values, found, energy, model.steps = bidiagonalise(rows, n, totals, min(components, dim))
        k = int((values[:components] > NO_DEVIATION * values[0]).sum())
        model.components, model.eigenvalues = found[:, :k], values[:k] ** 2 / n
        model.explained = values[:k] ** 2 / energy
        model.identity_error = _identity_error(rows, model)
    forget(rows)
    return model


def _whitened(xc: np.ndarray, model: Whitening) -> np.ndarray:
    return (xc @ model.components) / np.sqrt(model.eigenvalues)


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    k = len(model.eigenvalues)

    def part(x: np.ndarray) -> np.ndarray:
        w = _whitened(_centred(x, model.n, model.totals), model)
        return (w.T @ w).ravel()

    return float(np.abs(_summed(rows, model.dim, part, "double").reshape(k, k) / model.n - np.eye(k)).max()) if k else 0.0


def _deviation(steps: np.ndarray) -> np.ndarray:
    """Sum of squares of whole numbers a row, exact; an error if one is too large for 64 bits."""
    if len(steps) and float(np.abs(steps).max()) ** 2 * steps.shape[1] < 2.0**62:
        return (steps * steps).sum(axis=1)
    exact = [sum(int(v) ** 2 for v in row) for row in steps]
    return np.array(exact, dtype=np.int64)


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Append ``deviation`` and ``whitened`` to the rows with a usable vector; the others are dropped.

    ``whitened`` has an entry a component; ``deviation`` is the sum over all
    dimensions of (n x - S)^2.  All other columns stay, nulls, repeated rows
    and clashing names included; columns named like the new ones are replaced.
    """
    vectors = vectors.drop("deviation", "whitened")
    at = vectors.columns.index(vector)
    more = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    k = len(model.eigenvalues)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = _grid(batch.column(at), model.dim)
            step = max(1, BLOCK // max(1, model.dim))
            for a in range(0, len(keep), step):
                steps = model.n * x[a : a + step] - model.totals
                values = _whitened(steps / model.n, model)
                offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * k)
                own = batch.take(pa.array(keep[a : a + step]))
                added = [pa.array(_deviation(steps)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *added], names=[*own.schema.names, "deviation", "whitened"])

    if not model.n:
        return vectors.where("false").withColumns({f.name: F.lit(None).cast(f.dataType) for f in more})
    return vectors.mapInArrow(rows, T.StructType([*vectors.schema.fields, *more]))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every usable vector of ``embeddings``, one row each."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors, 16)
    explained = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
