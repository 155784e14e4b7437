"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Vectors become integers, ``floor(scale * c) + shift``; A is the matrix of their rows with the mean
taken off each dimension.  Starting from a unit vector v, the bidiagonalisation alternates the
products u = Av and v = Aᵀu, each made orthogonal to all before it (twice), and gathers their lengths
in an upper bidiagonal matrix B.  Its small singular value decomposition turns the v into the
eigenvectors of the covariance, and its squared singular values over n are their eigenvalues.

One step is one pass: each task multiplies its centred rows by v and the product back by the
rows, and the d sums are merged before the shuffle.  A left vector has an entry for every row, so it
is never put together: u = Aw with w of d entries, and Aᵀu and the products of left vectors
follow from w and from sums already made.  So only vectors of d entries reach the driver.

A sweep ends when the wanted singular triplets have residuals below ``SETTLED`` of the largest
singular value, or when an invariant subspace is exhausted; as one start vector sees one direction
of a multiple eigenvalue only, another sweep starts from a random vector orthogonal to all
before, until its own largest singular value has settled below the wanted ones, or all d
dimensions are spanned.  Components with an eigenvalue up to ``ZERO`` of the largest cannot be told from
rounding and are left out, so vectors without spread give no rows.

Vectors that are null or hold null or non-finite components, or one whose integer does not fit in 60
bits, take no part, nor do vectors of another length than the most common one (the larger, on a
tie).  Rows that repeat an id, and rows with a null id, count and are returned each on its own.  A
deviation beyond the range of a long is null.  Only the id and the vector column are read, so others
cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import written
from corpusforge.llm.slice_codes import kept_vectors

COMPONENTS, SCALE, SHIFT, SEED = 32, 64, 1_000_000, 20240502
#: Vectors of a block, one row of the table that the passes read.
BLOCK = 1024
SETTLED, ZERO = 1e-14, 1e-11


class Centre:
    """The exact mean of each dimension, as a whole number and a rest below one."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A block's whole numbers less the whole mean, and its centred rows in double precision."""
        apart = np.frombuffer(raw, np.int64).reshape(-1, len(self.whole)) - self.whole
        return apart, apart - self.rest / self.n

    def deviation(self, apart: np.ndarray) -> list[int | None]:
        """Exact squared distance of n times each row to the sums; None beyond a long."""
        most = float(np.abs(apart).max() + 1) * self.n
        if most * most * apart.shape[1] < 2.0**62:
            far = apart * self.n - self.rest
            return (far * far).sum(axis=1).tolist()
        far = apart.astype(object) * self.n - self.rest
        return [s if s < 1 << 63 else None for s in (far * far).sum(axis=1)]


def _packed(dimension: int, scale: int, shift: int, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            x = np.floor(batch.column(0).flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64) + shift
            x = x.reshape(-1, dimension)
            starts = list(range(0, len(x), BLOCK))
            ids = pa.ListArray.from_arrays(pa.array([*starts, len(x)], pa.int32()), batch.column(1).cast(kind))
            raw = pa.array([x[s : s + BLOCK].tobytes() for s in starts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, raw], names=["ids", "x"])

    return run


def _sums(dimension: int):
    """Exact sums of the dimensions and, last, the number of rows."""

    def run(batches):
        total = [0] * (dimension + 1)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.int64).reshape(-1, dimension)
                high, low = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)
                for k in range(dimension):
                    total[k] += (int(high[k]) << 20) + int(low[k])
                total[dimension] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension + 1), pa.int32()), pa.array([str(t) for t in total])], names=["place", "total"])

    return run


def _merged(blocks: DataFrame, size: int, sums_of) -> np.ndarray:
    """Sums over all blocks of an array of ``size`` doubles made from each; only the sums reach the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += sums_of(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = blocks.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["place"]] = r["value"]
    return out


def _product(blocks: DataFrame, centre: Centre, v: np.ndarray) -> np.ndarray:
    """Aᵀ(Av), one pass."""

    def there_and_back(raw: bytes) -> np.ndarray:
        _, a = centre.rows(raw)
        return a.T @ (a @ v)

    return _merged(blocks, len(v), there_and_back)


def _orthogonal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis.T @ (basis @ x)
    return x


def bidiagonalise(product, dimension: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of A (fewer, if it has fewer dimensions) and their right vectors, as rows.

    ``product(v)`` is Aᵀ(Av).
    """
    rng = np.random.default_rng(seed)
    right = np.empty((0, dimension))
    left, back = np.empty((0, dimension)), np.empty((0, dimension))  # u = A left, Aᵀu = back
    b = np.zeros((dimension, dimension))  # bidiagonal, but for the column in which a sweep starts
    sweep = 0  # first column of the current sweep
    v = rng.normal(size=dimension)
    v /= np.linalg.norm(v)
    for k in range(dimension):
        right = np.vstack([right, v])
        w, y = v, product(v)
        for _ in range(2):
            h = left @ y
            w, y = w - left.T @ h, y - back.T @ h
            b[:k, k] += h
        length = np.sqrt(max(w @ y, 0.0))
        if length <= 1e-12 * np.abs(b).max():
            w, y = np.zeros(dimension), np.zeros(dimension)
        else:
            b[k, k] = length
            w, y = w / length, y / length
        left, back = np.vstack([left, w]), np.vstack([back, y])
        small = b[: k + 1, : k + 1]
        p, sigma, q = np.linalg.svd(small)
        outside = back - (back @ right.T) @ right
        rest = _orthogonal(outside[k], right)
        length = np.linalg.norm(rest)
        exhausted = length <= 1e-13 * sigma[0]
        residual = np.linalg.norm(p.T @ outside, axis=1)[:wanted]
        settled = exhausted or (k + 1 >= wanted and (residual <= SETTLED * sigma[0]).all())
        if sweep and settled and not exhausted:
            # the sweep's own part of B tells what it adds
            p_own, own, _ = np.linalg.svd(small[sweep:, sweep:])
            miss = np.linalg.norm(p_own[:, 0] @ outside[sweep:])
            if miss <= 1e-3 * sigma[0] and own[0] + miss < sigma[wanted - 1]:
                break
            settled = miss <= SETTLED * sigma[0]
        if settled:
            sweep = k + 1
            rest = _orthogonal(rng.normal(size=dimension), right)
            length = np.linalg.norm(rest)
        v = rest / length if length else rest
    return sigma[:wanted], q[:wanted] @ right


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each row that takes part and component."""
    kept, dimension = kept_vectors(vectors, id_col, vector_col, [], 4 * scale)
    kind = kept.schema["_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dimension:
        return spark.createDataFrame([], schema)
    arrow = kept.select("_id").limit(0).toArrow().schema.field(0).type
    blocks = written(spark, kept.select("_v", "_id").mapInArrow(_packed(dimension, scale, shift, arrow), f"ids array<{kind}>, x binary"))
    sums = blocks.select("x").mapInArrow(_sums(dimension), "place int, total string")
    sums = {r["place"]: int(r["total"]) for r in sums.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    centre = Centre(sums[dimension], [sums[k] for k in range(dimension)])

    def squares(raw: bytes) -> np.ndarray:
        _, a = centre.rows(raw)
        return np.array([np.vdot(a, a)])

    trace = float(_merged(blocks, 1, squares)[0])
    sigma, axes = bidiagonalise(lambda v: _product(blocks, centre, v), dimension, min(components, dimension))
    real = sigma**2 > ZERO * sigma[0] ** 2
    sigma, axes = sigma[real], axes[real]
    k = len(sigma)
    if not k:
        return spark.createDataFrame([], schema)
    turn = axes.T / (sigma / np.sqrt(centre.n))

    def moments(raw: bytes) -> np.ndarray:
        white = centre.rows(raw)[1] @ turn
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    both = _merged(blocks, k + k * k, moments) / centre.n
    identity_error = float(np.abs(both[k:].reshape(k, k) - np.outer(both[:k], both[:k]) - np.eye(k)).max())
    explained = sigma**2 / trace

    def rows(batches):
        names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                apart, a = centre.rows(raw)
                m = len(a)
                take = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array(centre.deviation(apart), pa.int64())
                columns = [
                    ids.values.take(take),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)),
                    deviation.take(take),
                    pa.array((a @ turn).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(rows, schema)
