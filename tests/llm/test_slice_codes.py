import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm.slice_codes import SMALL, Slices, compress
from corpusforge.llm.queries import QUERIES


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain loops over Python integers: (id, code, error) sorted, and the codebooks."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows]
    width = -(-len(kept[0][1]) // parts)
    kept = [(i, v + [0] * (width * parts - len(v))) for i, v in kept]
    first = [v for _, v in sorted(k for k in kept if k[0] is not None)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in kept:
                piece = v[p * width : (p + 1) * width]
                own.setdefault(nearest(piece, books[p])[1], []).append(piece)
            for k, pieces in own.items():
                books[p][k] = [sum(c) // len(pieces) for c in zip(*pieces, strict=True)]
    coded = []
    for i, v in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        coded.append((i, bytes(k for _, k in found), sum(d for d, _ in found)))
    return sorted(coded, key=str), books


def found(spark, rows, **given):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("error", F.lit("x")).withColumn("_v", F.lit(1))
    out, books = compress(spark, vectors, **given)
    return sorted(((r.vec_id, bytes(r.code), r.error) for r in out.collect()), key=str), [b.tolist() for b in books]


@pytest.mark.parametrize("entries", [1, 3, 64, 65, 200])
def test_masks_hold_exactly_the_entries_within_the_radius(entries):
    rng = np.random.default_rng(entries)
    book = rng.integers(-6, 6, (entries, 5))
    x = rng.integers(-8, 8, (40, 5))
    radius = rng.integers(0, 6, 40)
    s = Slices(book)
    bits = np.unpackbits(s.within(np.ascontiguousarray(x.T), radius).view(np.uint8), axis=1, bitorder="little")
    want = (np.abs(x[:, None] - book[None]) <= radius[:, None, None]).all(axis=2)
    assert (bits[:, :entries] == want).all() and not bits[:, entries:].any()
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    best, squares = s.nearest(x)
    assert (best == far.argmin(axis=1)).all() and (squares == far.min(axis=1)).all()


@pytest.mark.parametrize("scale_up", [1, 2.0**26, 2.0**45])
def test_against_brute_force(spark, scale_up):
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.normal(size=10).round(2) * scale_up / 1024).tolist()) for i in rng.permutation(60)]
    rows += [(3, rows[0][1]), (None, rows[1][1]), rows[2], rows[2]]
    given = {"parts": 3, "entries": 9, "rounds": 3}
    want, books = brute(rows, **given)
    assert (scale_up > 1) == (max(abs(c) for b in books for e in b for c in e) > SMALL)
    got, own = found(spark, rows, **given)
    want = [(i, c, e if e < 1 << 63 else None) for i, c, e in want]
    assert own == books and got == want


def test_ties_few_rows_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0, -0.5]), (1, None), (2, [nan] * 4), (3, [0.0, inf, 0.0, 0.0]), (6, [0.0, None, 0.0, 0.0]), (7, [0.0]), (8, []), (10, [1e30, 0.0, 0.0, 0.0])]
    got, books = found(spark, rows)
    assert [(i, c) for i, c, _ in got] == [(4, b"\0\0\0\0"), (5, b"\1\0\0\1"), (9, b"\0\0\0\0")]
    assert [len(b) for b in books] == [3] * 4 and [e for _, _, e in got] == [0, 0, 0]
    assert found(spark, rows[3:7] + rows[8:9])[0] == []
    assert found(spark, [(None, [1.0] * 4)])[0] == []
    empty, _ = compress(spark, spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error"]


def test_query_digests(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in vectors.collect()]
    label = {r.vec_id: r.label for r in vectors.collect()}
    want, books = brute(rows)
    sums = {}
    for i, _, e in want:
        sums[label[i]] = sums.get(label[i], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    got = QUERIES["op11_slice_codes"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted((i, c.hex(), e, sums[label[i]], digest) for i, c, e in want)
