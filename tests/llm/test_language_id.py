import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm.language_id import UNKNOWN, WINDOW, LanguageModel, held_out, learn, predicted, train


def test_gradients_match_differences():
    model = LanguageModel.start(["a", "b", "c"], 4, 1)
    for d in (model.forward, model.backward):
        d.table, d.gates, d.candidate = (x.astype(np.float64) for x in (d.table, d.gates, d.candidate))
    model.weights, model.bias = model.weights.astype(np.float64), model.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    bytes_, labels = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    _, grads = model.loss(bytes_, labels)
    for p, g in zip(model.parameters(), grads, strict=True):
        for _ in range(3):
            at = (int(bytes_[2, 1]), int(rng.integers(p.shape[1]))) if p.shape[0] == 256 else tuple(rng.integers(0, s) for s in p.shape)
            old, e = p[at], 1e-3
            p[at] = old + e
            up = model.loss(bytes_, labels)[0]
            p[at] = old - e
            down = model.loss(bytes_, labels)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=2e-4, rel=2e-2)


def test_pooling_reads_every_position():
    """Document probabilities equal the mean over positions of each window on its own, whatever stands beside it."""
    model = train([("x", "abab" * 20), ("y", "cdcd" * 20)], steps=30)
    texts = [b"a", b"abcd" * 100, b"x" * WINDOW, b"cd" * WINDOW + b"e"]
    together = model.probabilities(texts)
    for t, p in zip(texts, together, strict=True):
        total = np.zeros(2)
        for at in range(0, len(t), WINDOW):
            w = np.frombuffer(t[at : at + WINDOW], np.uint8).astype(np.intp)[:, None]
            states = np.concatenate([model.forward.states(w), model.backward.states(w[::-1])[::-1]], axis=2)
            logits = (states @ model.weights + model.bias)[:, 0]
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            total += (q / q.sum(axis=1, keepdims=True)).sum(axis=0)
        assert p == pytest.approx(total / len(t), abs=1e-5)
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = learn(docs)
    rows = docs.where(held_out(F.col("doc_id"))).select("doc_id", "lang", predicted(model).alias("p")).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.p.lang for r in rows) / len(rows) > 0.99
    assert all(0 <= r.p.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? \n", "en"), (4, "the cat", None), (None, "the dog and the cat", "en"), (5, "the dog", "en"), (5, "the dog", "en"), (6, "der Hund", "de"), (7, "the" * 100000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("p", F.lit(1)).withColumn("score", F.lit(2))
    model = learn(docs)
    out = docs.select("doc_id", "text", predicted(model).alias("q")).collect()
    for r in out:
        nothing = not r.text or not any(map(str.isalpha, r.text))
        assert (r.q.lang == UNKNOWN and r.q.score == 0) if nothing else r.q.lang in model.languages
    assert learn(docs.limit(0)).languages == []
    assert docs.limit(0).select(predicted(model).alias("q")).count() == 0
    unlearned = docs.select(predicted(learn(docs.limit(0))).alias("q")).collect()
    assert {r.q.lang for r in unlearned} == {UNKNOWN}


def slow(model, text):
    """The network byte by byte, in double precision: mean probabilities of a text."""
    def logistic(v):
        return 1 / (1 + np.exp(-v))

    def states(d, window):
        size, h, out = d.candidate.shape[0], np.zeros(d.candidate.shape[0]), []
        for b in window:
            x = d.table[b].astype(np.float64)
            z, r = np.split(logistic(x[: 2 * size] + h @ d.gates), 2)
            c = np.tanh(x[2 * size :] + (r * h) @ d.candidate)
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    total = np.zeros(len(model.languages))
    for at in range(0, len(text), WINDOW):
        w = text[at : at + WINDOW]
        for a, b in zip(states(model.forward, w), states(model.backward, w[::-1])[::-1], strict=True):
            logits = np.concatenate([a, b]) @ model.weights + model.bias
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / len(text)


def test_query_against_a_network_run_byte_by_byte(spark):
    from corpusforge.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op10_language_id"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        text = texts[r.doc_id]
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == (UNKNOWN, 0.0)
            continue
        p = slow(model, text.encode())
        assert r.score == pytest.approx(p.max(), abs=1e-3)
        assert r.lang_pred == model.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 2e-3


def test_any_number_of_languages(spark):
    rows = [(k, f"word{k} " * 3, f"l{k % 230}") for k in range(460)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 200
