import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm.lanczos_whitening import Centre, bidiagonalise, whiten
from corpusforge.llm.queries import QUERIES


def integers(rows):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]


def check(got, rows, most=32, key=lambda r: r.vec_id):
    """All rows of an operator's result against numpy's eigenvectors of the exact covariance."""
    x = integers([v for _, v in rows])
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    far = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    a = np.array(far, dtype=float) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-11 * values[0]).sum()))
    white = a @ vectors[:, :k] / np.sqrt(values[:k])
    table = {(key(r), r.component): r for r in got}
    assert len(got) == n * k
    sign = {}
    for row, (i, _) in enumerate(rows):
        for c in range(k):
            r = table[i, c + 1]
            deviation = sum(f * f for f in far[row])
            assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-8
            alone = (c == 0 or values[c - 1] - values[c] > 1e-5 * values[0]) and (c + 1 == len(values) or values[c] - values[c + 1] > 1e-5 * values[0])
            if alone:
                s = sign.setdefault(c, 1.0 if r.whitened * white[row, c] >= 0 else -1.0) if abs(white[row, c]) > 1e-3 else sign.get(c)
                if s is not None:
                    assert r.whitened == pytest.approx(s * white[row, c], abs=1e-6)
    return len(sign)


@pytest.mark.parametrize("shape", [(200, 12, 12), (200, 40, 8), (5, 30, 10), (300, 60, 32), (1, 4, 4)])
def test_bidiagonalisation_against_dense_decomposition(shape):
    n, d, wanted = shape
    a = np.random.default_rng(n + d).normal(size=(n, d)) * 1.3 ** -np.arange(d)
    steps = []
    sigma, axes = bidiagonalise(lambda v: (steps.append(1), a.T @ (a @ v))[1], d, wanted)
    want = np.linalg.svd(a, compute_uv=False)[:wanted]
    assert sigma[: len(want)] == pytest.approx(want, abs=1e-9 * want[0])
    real = sigma > 1e-6 * sigma[0]
    assert axes[real] @ axes[real].T == pytest.approx(np.eye(real.sum()), abs=1e-10)
    assert np.linalg.norm(a @ axes[real].T, axis=0) == pytest.approx(sigma[real], abs=1e-9 * want[0])
    assert len(steps) <= d


def test_multiple_singular_values_are_all_found_and_steps_end_early():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(200, 200)))
    values = np.array([9.0, 9.0, 9.0, 5.0, 5.0, 4.0] + [0.001 * (1 - k / 400) for k in range(194)])
    gram = (q * values**2) @ q.T
    steps = []
    sigma, axes = bidiagonalise(lambda v: (steps.append(1), gram @ v)[1], 200, 6)
    assert sigma == pytest.approx(values[:6], abs=1e-9) and len(steps) < 150
    assert axes @ axes.T == pytest.approx(np.eye(6), abs=1e-10)


def test_deviation_is_exact():
    x = np.array([[5, -7], [2**40, 3], [1, 1]])
    c = Centre(3, [int(v) for v in x.sum(axis=0)])
    apart, a = c.rows(x.astype(np.int64).tobytes())
    want = [sum((3 * int(v) - int(s)) ** 2 for v, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    assert c.deviation(apart) == [w if w < 1 << 63 else None for w in want]
    assert a == pytest.approx(x - x.mean(axis=0))


def test_against_dense_decomposition(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=8) * 2.0 ** -np.arange(8)).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("_v", F.lit(1)).repartition(5)
    assert check(whiten(spark, vectors).collect(), rows) == 8
    assert check(whiten(spark, vectors, components=3).collect(), rows, most=3) == 3


def test_query(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = QUERIES["op12_lanczos_whitening"](spark, "/root/testdata/sf0.001")
    assert [f.name + " " + f.dataType.simpleString() for f in got.schema] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    assert check(got.collect(), rows) > 0


def test_rows_that_take_no_part_repeats_and_no_spread(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.0]), (2, [4.0, 2.0, 1.0]), (3, [0.0, 2.0, -5.0]), (None, [1.0, 2.0, 3.5])]
    bad = [(4, None), (5, [nan, 1.0, 1.0]), (6, [1.0, inf, 1.0]), (7, [1.0, None, 1.0]), (8, [1.0]), (9, []), (10, [1e300, 0.0, 0.0])]
    vectors = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    check(whiten(spark, vectors).collect(), good)
    twice = whiten(spark, vectors.unionByName(vectors.where("vec_id = 1"))).collect()
    assert len(twice) == 5 * 2 and len([r for r in twice if r.vec_id == 1]) == 4 and {r.n for r in twice} == {5}
    for few in (vectors.limit(0), vectors.where("vec_id > 3"), vectors.where("vec_id = 1")):
        none = whiten(spark, few)
        assert none.collect() == [] and none.columns[0] == "vec_id"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whiten(spark, same).collect() == []
