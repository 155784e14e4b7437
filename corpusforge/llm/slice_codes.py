"""Vector code compression: a product quantizer whose nearest entries are found by slice-and-intersect bitmasks.

Vectors become integers, ``floor(scale * x)``, and are cut into ``parts`` equal pieces with a
codebook each.  A codebook starts as the pieces of the ``entries`` smallest ids; each round assigns
every piece to its nearest entry and moves each entry to the componentwise ``floor(sum / count)`` of
its pieces, entries without pieces stay.  After the last round pieces are assigned once more.

Nearest entry: for each dimension of a codebook the entries' coordinates are sorted, and each place
of that order carries the mask of the entries before it, as uint64 words.  The distance to the best
of a few pilot entries is the initial radius: an entry that is as near lies within it in every
dimension.  Two searches in the sorted coordinates give a dimension's slice, the exclusive or of two
prefix masks, and the masks of all dimensions are intersected.  Slices of a part of the radius come first:
the best entry in them makes the radius, whose slices hold every nearest entry, as small as it can be.
Candidates alone are measured, exactly, in integers; ties go to the lower index.

A round is one pass over the vectors; tasks send sums for each entry (their number depends on the
codebooks alone), which are merged before the shuffle.  Only codebooks, ``entries`` x dimension
integers, reach the driver.

Vectors that are null or hold null or non-finite components, or one whose integer does not fit in 62
bits, take no part, nor do vectors of another length than the most common one (the larger, on a
tie).  A length that ``parts`` does not divide is filled up with zeros.  Rows that repeat an id are
coded each on its own; they start codebooks in the order of their vectors, rows with a null id
start none.  An error beyond the range of a long is null.  Only the named columns are read, so others
cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries whose best distance is the initial radius, and sixteenths of it that are sliced first.
PILOTS, NARROW = 16, 8
#: Vectors that are searched for together.
BLOCK = 4096
#: Integers up to this size are squared and summed in 64 bits, greater ones as Python integers.
SMALL = 1 << 24
_LARGEST = float(1 << 62)


class Slices:
    """The entries of one codebook with their coordinates sorted and prefix masks for each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, self.width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        self.prefix = np.zeros((self.width, n + 1, -(-n // 64)), np.uint64)
        for place in range(n):
            entry = order[place]
            self.prefix[:, place + 1] = self.prefix[:, place]
            self.prefix[np.arange(self.width), place + 1, entry // 64] |= np.uint64(1) << (entry % 64).astype(np.uint64)

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ from each column of ``x`` by at most its radius in every dimension."""
        mask = np.broadcast_to(self.prefix[0, -1], (x.shape[1], self.prefix.shape[2])).copy()
        for d in range(self.width):
            low = np.searchsorted(self.sorted[d], x[d] - radius, side="left")
            high = np.searchsorted(self.sorted[d], x[d] + radius, side="right")
            mask &= self.prefix[d, high] ^ self.prefix[d, low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry: the narrow slices first, whose best is the last radius."""
        x = np.ascontiguousarray(x.T)
        far = np.array([_squared(x, e) for e in self.entries[:PILOTS]])
        best, found = far.argmin(axis=0), far.min(axis=0)
        near = self.within(x, _root(found) * NARROW // 16)
        self._measure(x, near, best, found)
        self._measure(x, self.within(x, _root(found)) & ~near, best, found)
        return best, found

    def _measure(self, x: np.ndarray, mask: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Measure the entries of each column's mask, and keep the nearest; of the same distance the lower index."""
        bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
        for k in np.nonzero(bits.any(axis=0))[0]:
            rows = np.nonzero(bits[:, k])[0]
            far = _squared(x[:, rows], self.entries[k])
            nearer = (far < found[rows]) | ((far == found[rows]) & (k < best[rows]))
            rows = rows[nearer]
            best[rows], found[rows] = k, far[nearer]


def _squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = x - entry[:, None]
    apart *= apart
    return apart.sum(axis=0)


def _root(squares: np.ndarray) -> np.ndarray:
    """A whole number that is no less than each square root."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) + 1 for s in squares], dtype=object)
    return np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of ``width`` whole numbers, as 64-bit or as Python integers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    x = x.reshape(len(column), -1) if len(column) else x.reshape(0, width)
    x = np.concatenate([x, np.zeros((len(x), width - x.shape[1]), np.int64)], axis=1)
    return x if not x.size or np.abs(x).max() <= SMALL else x.astype(object)


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries (rows x parts) and the squared distances summed over parts."""
    if books[0].size and max(np.abs(b).max() for b in books) > SMALL:
        x = x.astype(object)
    if x.dtype == object:
        books = [b.astype(object) for b in books]
    slices = [Slices(b) for b in books]
    width = books[0].shape[1]
    codes = np.empty((len(x), len(books)), np.int64)
    error = np.zeros(len(x), x.dtype)
    for start in range(0, len(x), BLOCK):
        block = slice(start, start + BLOCK)
        for p, s in enumerate(slices):
            codes[block, p], far = s.nearest(x[block, p * width : (p + 1) * width])
            error[block] += far
    return codes, error


def _batches(batches, vector: int, width: int, scale: int):
    """Batches joined to blocks, as masks are made anew for each."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4 * BLOCK):
            part = batch.slice(start, 4 * BLOCK)
            yield part, _integers(part.column(vector), width, scale)


def _entry_sums(books: list[np.ndarray], scale: int):
    n, width = books[0].shape

    def run(batches):
        sums = np.zeros((len(books), n, width + 1), object)
        for _part, x in _batches(batches, 0, width * len(books), scale):
            codes, _ = assign(x, books)
            for p in range(len(books)):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                own = x[order, p * width : (p + 1) * width]
                sums[p, used, :width] += np.add.reduceat(own, first, axis=0)
                sums[p, used, width] += np.diff(np.append(first, len(order)))
        part, entry, place = np.nonzero(np.broadcast_to(sums[:, :, width:] > 0, sums.shape))
        total = pa.array([str(v) for v in sums[part, entry, place]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), total], names=["part", "entry", "place", "total"])

    return run


def _codes(books: list[np.ndarray], scale: int):
    width = books[0].shape[1]
    schema = pa.schema([("code", pa.binary()), ("error", pa.int64())])

    def run(batches):
        for part, x in _batches(batches, 0, width * len(books), scale):
            codes, error = assign(x, books)
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            fits = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
            rest = part.columns[1:]
            yield pa.RecordBatch.from_arrays([code, fits, *rest], names=[*schema.names, *part.schema.names[1:]])

    return run


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, carry: list[str], scale: int) -> tuple[DataFrame, int]:
    """``_v, _id`` and the carried columns of the rows that take part, and their length (0: no rows)."""
    slim = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("_v"), F.col(f"`{id_col}`").alias("_id"), *(F.col(f"`{c}`") for c in carry))
    finite = F.forall("_v", lambda c: F.coalesce(F.abs(c) < F.lit(_LARGEST / scale), F.lit(False)))
    slim = slim.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & finite)
    sizes = slim.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dimension = sizes[0]["n"] if sizes else 0
    return slim.where(F.size("_v") == dimension), dimension


def learn_codebooks(kept: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One integer matrix for each part, a row for each entry; no rows if no vector has an id."""
    width = -(-dimension // parts)
    first = kept.where("_id is not null").orderBy("_id", "_v").select("_v").limit(entries).collect()
    seeds = _integers(pa.array([r["_v"] for r in first], pa.list_(pa.float64())), width * parts, scale).astype(np.int64)
    books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    if not len(seeds):
        return books
    for _ in range(rounds):
        sums = kept.select("_v").mapInArrow(_entry_sums(books, scale), "part int, entry int, place int, total string")
        found = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        count = {(r["part"], r["entry"]): int(r["total"]) for r in found if r["place"] == width}
        for r in found:
            if r["place"] < width:
                books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // count[r["part"], r["entry"]]
    return books


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows that take part as ``id, code, error`` and the carried columns, and the codebooks.

    ``code`` has one byte for each part, the index of its entry; ``error`` is the squared distance of the integers.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0 or scale < 1:
        raise ValueError("an entry's index is one byte; parts and scale are positive")
    kept, dimension = kept_vectors(vectors, id_col, vector_col, list(carry), scale)
    books = learn_codebooks(kept, dimension, parts, entries, rounds, scale) if dimension else [np.empty((0, 0), np.int64)] * parts
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    names = ["_id", *carry]
    schema = "`_code` binary, `_error` long, " + ", ".join(f"`{c}` {kinds[c]}" for c in names)
    if not len(books[0]):
        coded = spark.createDataFrame([], schema)
    else:
        coded = kept.select("_v", *(F.col(f"`{c}`") for c in names)).mapInArrow(_codes(books, scale), schema)
    return coded.select(F.col("_id").alias(id_col), F.col("_code").alias("code"), F.col("_error").alias("error"), *(F.col(f"`{c}`") for c in carry)), books
