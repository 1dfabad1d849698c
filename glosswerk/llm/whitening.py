"""Whitening of embeddings by LOBPCG on the distributed covariance.

Each component c becomes the integer x = floor(1024 c) + 100000, so that counts and
sums are exact: with n vectors and sums S, the centred row n x - S is an exact integer,
and no digits are lost to the common offset.  The covariance V (divisor n) is never
formed.  A step of the block method needs V times a block of directions, which is the
sum over rows of the centred row times its products with the block: every task adds up
its own rows, Spark adds the tasks', and the driver gets one number for each dimension
and direction.

The block has ``COMPONENTS`` + ``GUARD`` directions.  Each step solves the small
eigenproblem on the span of iterate, residuals and previous directions
(Rayleigh-Ritz), until every wanted pair is certified: |V q - e q| <= ``TOLERANCE``
times the largest eigenvalue.  The products of the final block with V are computed anew,
so the certificate holds for what is used.  Where three blocks fill the space the second
step is exact.  Components that get no certificate in ``STEPS`` steps raise.

Odd input: rows whose vector is null or empty or holds null or non-finite entries (or
any of 2**43 or more, whose x has no exact double) are left out; a table whose products n x
exceed a long raises; a null vec_id and repeated rows take part as they are.  Vectors of different lengths
have no common covariance, so each length is whitened by itself, one after the other.
A direction without variance has no whitened value: components with an
eigenvalue of at most ``RANK`` times the largest are not returned (none at all where all
vectors are equal).  ``deviation`` is null where it exceeds a long.  Columns other than
the two named are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswerk.llm.shared import Scratch
from glosswerk.llm.vectors import matrix

COMPONENTS = 8
GUARD = 16
TOLERANCE = 1e-13
RANK = 1e-11
STEPS = 500
SCALE, OFFSET = 1024, 100_000
#: Rows of an Arrow batch are handled so many at a time.
ROWS = 4096


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>) of the rows that take part."""
    c = F.col(embedding).cast("array<double>")
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**43))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c")).where((F.size("c") > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + OFFSET).alias("x"))


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dims: int, kind: str, columns: str = "x") -> np.ndarray:
    """The sum over all rows of ``part`` of their integers, as a vector: tasks add up
    their own rows, Spark adds the tasks' entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(columns)]), dims).astype(np.int64)
            for k in range(0, len(x), ROWS):
                one = part(x[k : k + ROWS])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["v"])

    sums = rows.select(columns).mapInArrow(run, f"v array<{kind}>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in sums.orderBy("k").collect()])


@dataclass
class Covariance:
    """Count, sums and products of one table of integer vectors of ``dims`` entries."""

    rows: DataFrame
    dims: int
    n: int
    sums: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, dims: int) -> Covariance:
        found = _added(rows, lambda x: np.append(x.sum(axis=0), len(x)), dims, "long")
        largest = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
        if largest * int(found[-1]) >= 2**62:
            raise OverflowError(f"{found[-1]} vectors with entries up to {largest} have no exact centred rows")
        return cls(rows, dims, int(found[-1]), found[:-1])

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums).astype(np.float64) / n

    def trace(self) -> float:
        c = self.centred()
        return float(_added(self.rows, lambda x: (c(x) ** 2).sum(axis=0), self.dims, "double").sum()) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block, one pass over the table."""
        c = self.centred()

        def part(x: np.ndarray) -> np.ndarray:
            rows = c(x)
            return (rows.T @ (rows @ block)).ravel()

        return _added(self.rows, part, self.dims, "double").reshape(block.shape) / self.n


def _basis(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal columns that span ``block`` beside ``against``; directions that are
    numerically inside the latter, or repeated, fall out."""
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s[0])]
    return block


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and unit eigenvectors (as columns) of the symmetric
    operator ``times``, certified by their residuals."""
    k = min(k, dims)
    q = _basis(np.random.default_rng(seed).normal(size=(dims, min(dims, k + guard))))
    before = np.empty((dims, 0))
    vq = times(q)
    for _ in range(steps):
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        order = np.argsort(-values)
        values, q, vq = values[order], q @ turn[:, order], vq @ turn[:, order]
        residual = vq - q * values
        if not values[0] > 0 or (np.linalg.norm(residual[:, :k], axis=0) <= tolerance * values[0]).all():
            return values[:k], q[:, :k]
        # one product for residuals and previous directions gives V on the whole span
        more = _basis(residual, q)
        more = np.hstack([more, _basis(before, np.hstack([q, more]))]) if before.shape[1] else more
        span = np.hstack([q, more])
        if not more.shape[1]:  # nothing is left to turn to: the block's own span is invariant
            return values[:k], q[:, :k]
        v_span = np.hstack([vq, times(more)])
        small = span.T @ v_span
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = turn[:, np.argsort(-values)[: q.shape[1]]]
        before = span[:, q.shape[1] :] @ best[q.shape[1] :]
        q = _basis(span @ best)
        vq = times(q)
    raise ArithmeticError(f"no certified components after {steps} steps")


def whiten(vectors: DataFrame, k: int = COMPONENTS, scratch: Scratch | None = None, **how) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "whitening")
    rows = scratch.write(integers(vectors), "rows")
    lengths = sorted(r.dims for r in rows.select(F.size("x").alias("dims")).distinct().collect())
    parts = [_whiten(rows.where(F.size("x") == d), d, k, **how) for d in lengths]
    none = spark.createDataFrame([], _RESULT)
    return reduce(DataFrame.unionByName, parts, none) if len(parts) != 1 else parts[0]


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(rows: DataFrame, dims: int, k: int, **how) -> DataFrame:
    v = Covariance.of(rows, dims)
    values, axes = lobpcg(v.times, dims, k, **how)
    trace = v.trace()
    some = values > RANK * max(values[0], 0.0) if trace > 0 else np.zeros(len(values), bool)
    values, axes = values[some], axes[:, some]
    m, n, sums, centred = len(values), v.n, v.sums, v.centred()
    scale = axes / np.sqrt(values)
    explained = values / trace if m else values

    def products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scale
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    error = 0.0
    if m:
        found = _added(rows, products, dims, "double")
        mean, second = found[:m] / n, found[m:].reshape(m, m) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                x = matrix(pa.chunked_array([piece.column("x")]), dims).astype(np.int64)
                exact = n * x - sums
                size = (exact.astype(np.float64) ** 2).sum(axis=1)
                fits = size < 2.0**62
                deviation = np.where(fits, (exact * exact).sum(axis=1), 0)
                large = [sum(int(e) ** 2 for e in exact[k]) for k in np.flatnonzero(~fits)]  # exact, to see which still fit
                deviation = pa.array(deviation, mask=~fits) if not large else pa.array([*_filled(deviation, fits, large)], pa.int64())
                w, rows_ = (exact.astype(np.float64) / n) @ scale, np.repeat(np.arange(len(x)), m)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id").take(rows_), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, n, np.int64)), deviation.take(pa.array(rows_)), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * m, error))],
                    schema=_ARROW,
                )

    return rows.mapInArrow(project, _RESULT)


_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _filled(deviation: np.ndarray, fits: np.ndarray, large: list[int]) -> Iterator[int | None]:
    rest = iter(large)
    for d, ok in zip(deviation.tolist(), fits.tolist(), strict=True):
        exact = d if ok else next(rest)
        yield exact if exact < 2**63 else None


def digests(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
