import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import block_repeats
from corpusforge.llm.block_repeats import Windows, remove_repeats, rolling, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Per row: words, removed runs and kept text, from every window of every text."""
    least = {}
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            if i is not None:
                h = tuple(w[k : k + window])
                least[h] = min(least.get(h, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def found(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("_hits", F.lit(2))
    out = remove_repeats(spark, docs, window=window).collect()
    for r in out:
        assert sum(x["stop"] - x["start"] for x in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=str)


def test_word_hashes_depend_on_the_words_alone():
    long = "x" * 1000
    texts = pa.array(["one two", None, "", " two\tone ", "one", "two", "é" * 5 + " 12345678 123456789 " + long, long + "\n12345678", "a\x00 a"])
    hashes, first = word_hashes(texts.slice(0, len(texts)))
    words = [WORD.findall(t or "") for t in texts.to_pylist()]
    assert np.diff(first).tolist() == [len(w) for w in words]
    by_word = {}
    for h, w in zip(hashes.tolist(), [x for ws in words for x in ws], strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    again, _ = word_hashes(texts.slice(3, 4))
    assert again.tolist() == hashes[first[3] : first[7]].tolist()


@pytest.mark.parametrize("width", [1, 3, 50])
def test_rolling_hashes_are_equal_for_equal_words_only(width):
    words = np.random.default_rng(1).integers(0, 2, 400).astype(np.uint64) * np.uint64(0x1234567890ABCDEF) + np.uint64(77)
    h = rolling(words, width)
    seen = {}
    for k in range(len(words) - width + 1):
        assert seen.setdefault(words[k : k + width].tobytes(), h[k]) == h[k]
    assert len({int(v) for v in seen.values()}) == len(seen)


def test_every_rolling_window_has_the_anchor_of_the_block_with_its_words():
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") for _ in range(300))
    for shift in range(12):
        # the same words behind other ones: blocks of the first are rolling windows of the second
        w = Windows(pa.array([text, "z " * shift + text]), 11)
        own = set(w.anchor[w.in_block & (w.row == 0)].tolist())
        assert own and own <= set(w.anchor[w.row == 1].tolist())
        hits = [np.array([-a for a in own])] * 2
        assert set(w.candidates(hits).tolist()) <= set(range(len(w.words)))


@pytest.mark.parametrize("held", [1, 1 << 21])
def test_settled_windows_do_not_depend_on_how_many_are_held(spark, monkeypatch, held):
    monkeypatch.setattr(block_repeats, "HELD", held)
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(9)}" for _ in range(40))
    rows = [(i % 30, f"{'a ' * (i % 7)}{passage} b{i % 3}") for i in range(50)]
    assert found(spark, rows, 9) == brute(rows, 9)


@pytest.mark.parametrize("window", [1, 2, 7, 50])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    passages = [" ".join(f"w{rng.randrange(4 if k % 2 else 30)}" for _ in range(rng.choice([window - 1, window, 3 * window]))) for k in range(6)]
    rows = [(None, passages[0]), (7, None), (8, ""), (9, " \n "), (10, "word " * 500), (11, "word " * 70)]
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(2 * window))) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(20, 60), rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += rows[-5:]
    assert found(spark, rows, window) == brute(rows, window)


def test_hot_passage_copies_and_long_texts(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(1000)}" for _ in range(60))
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + passage + f" end{i}") for i in range(400)]
    copy = " ".join(f"c{rng.randrange(1000)}" for _ in range(200))
    rows += [(i, copy) for i in range(1000, 1300)]
    rows += [(1500, copy + " and more")] * 200  # one row many times
    rows += [(2000, " ".join(f"l{rng.randrange(10**6)}" for _ in range(60_000)) + " " + copy), (2001, "x" * 300_000)]
    got = found(spark, rows, 50)
    assert got == brute(rows, 50)
    removed = {i: n for i, _, n, _ in got}
    assert removed[0] == 0 and removed[399] == 60 and removed[1000] == 0 and removed[1299] == 200 and removed[1500] == 200 and removed[2000] == 200


def test_sf_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = remove_repeats(spark, docs)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str) == brute(rows, 50)
    empty = remove_repeats(spark, docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_removed", "removed", "kept"]
