import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import cross_polytope
from corpusforge.llm.cross_polytope import axes, exact_cosine, hadamard, nearest, signs, turned


def brute(rows, queries, k=5):
    """All cosines of the rows that take part, in double precision."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in queries:
        s = exact_cosine(np.broadcast_to(np.array(v, dtype=np.float64), x.shape), x)
        best = sorted((-s[j], int(ids[j])) for j in range(len(ids)) if ids[j] != i)
        out[i] = [(j, -t) for t, j in best[:k]]
    return out


def test_rotation_is_orthonormal_and_axes_are_nearest():
    x = np.random.default_rng(0).normal(size=(20, 13))
    own = signs(2, 16)
    y = turned(x, own[1])
    assert np.linalg.norm(y, axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert y @ y.T == pytest.approx(x @ x.T)
    assert hadamard(hadamard(y)) == pytest.approx(y)
    both = np.concatenate([np.eye(16), -np.eye(16)])
    assert (axes(y, 1)[:, 0] == (y @ both.T).argmax(axis=1)).all()
    assert (axes(y, 4)[:, 0] == axes(y, 1)[:, 0]).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_recall_and_exact_scores(spark, monkeypatch, block):
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", block)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got = {}
    for r in nearest(spark, vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    x = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 5 and q not in {i for i, _ in found}
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        for i, s in found:
            assert s == pytest.approx(x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i])), abs=1e-12)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (9, [3.0, 0.0, 0.0]), (9, [3.0, 0.0, 0.0]), (50, [1e-200, 0.0, 0.0]), (100, None), (150, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("id", F.lit(1))
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(spark, vectors, F.col("vec_id") % 50 == 0, k=3).collect())
    assert [x for x in out if x[0] == 0][:2] == [(0, 1, 1), (0, 2, 9)]
    assert {x[0] for x in out} == {0, 50} and all(x[2] in (0, 1, 2, 9, 50) for x in out)
    assert nearest(spark, vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest(spark, vectors, F.col("vec_id") == 4).count() == 0


def test_repeats_crowd_out_no_neighbour(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(0, base.tolist())] + [(7, (base + 0.01 * rng.normal(size=64)).tolist()) for _ in range(8)]
    rows += [(k, (base + 0.3 * rng.normal(size=64)).tolist()) for k in range(100, 122)]
    got = nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert len(got) == 5 and got[0].vec_id == 7 and len({r.vec_id for r in got}) == 5
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    qi, xi, score = cross_polytope.nearest_in_block(np.array([0]), x[:1], ids, x, 5)
    want = {}
    for i, s in zip(ids, exact_cosine(np.broadcast_to(x[0], x.shape), x), strict=True):
        want[i] = max(want.get(i, -2), s)
    want = sorted((-s, i) for i, s in want.items() if i)[:5]
    assert [(int(ids[k]), s) for k, s in zip(xi, score, strict=True)] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("n", [2, 4, 6])
def test_all_candidates_if_there_are_fewer(spark, n):
    rng = np.random.default_rng(n)
    rows = [(50 * i, rng.normal(size=64).tolist()) for i in range(n)]
    got = nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, rows)
    assert {q: [(i, round(s, 12)) for i, s in v] for q, v in want.items()} == {q: [(r.vec_id, round(r.score, 12)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
