"""Work on distinct words gives what work on whole texts gives, and lattices are reduced as they would be built."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.text import MAX_SENTENCE_BYTES
from corpusforge.operators import vocab as V
from corpusforge.operators import word_counts as W
from corpusforge.operators.unigram_learner import Block, Trie

POOL = [*"aeiouAy0123 \t\n\x0b\f\r .,-", *map(chr, range(0x300, 0x308)), *"ﬁＡ①éạ´¨῁ｶﾞ½㎏▁日本かкΑβ한글", "　", "​", "\x01", "\x7f", "\xa0", " ", "\x85", "\x00", "▅"]


def drawn_texts(draw, n):
    texts = ["".join(draw.choice(POOL) for _ in range(draw.randrange(60))) for _ in range(n)]
    long = [" ".join(draw.choice(["long", "words", "é１2"]) for _ in range(MAX_SENTENCE_BYTES // 4)) for _ in range(2)]
    return [*texts, *texts[:20], *long, None, "", " ", "▁", "´"]


@pytest.mark.parametrize("spec", ["cc-html1K", "cc-html1K,sd=t", "cc-html1K,su=f,sn=f", "cc-html1K,ws=t"])
def test_units_of_words_are_the_units_of_texts(spark, spec):
    spec = V.VocabSpec.parse(spec)
    docs = spark.createDataFrame([(t,) for t in drawn_texts(random.Random(4), 600)], "text string").repartition(3)
    words = V.corpus_words(docs).checkpoint()
    whole = docs.select(F.explode(V.presplit(F.col("text"), spec)).alias("u")).groupBy("u").count()
    parts = words.select(F.explode(V.presplit(F.col("word"), spec)).alias("u"), "n").groupBy("u").agg(F.sum("n").alias("n"))
    assert {r.u: r.n for r in parts.where("n > 0").collect()} == {r.u: r["count"] for r in whole.collect()}
    cut = V.corpus_text(docs).select(F.explode(V.presplit(F.col("text"), spec)).alias("u")).groupBy("u").count()
    want = {r.u: float(r["count"]) for r in cut.collect()}
    assert {r.unit: r.c for r in V.unit_counts(docs, spec).collect()} == want
    assert {r.unit: r.c for r in V.unit_counts(docs, spec, words=words).collect()} == want


def test_units_that_look_beyond_a_word_are_those_of_texts():
    parse = V.VocabSpec.parse
    assert V.splits_at_words(parse("cc-html1K"), ["<mask>"]) and not V.splits_at_words(parse("cc-html1K"), ["a▁b"])
    assert V.splits_at_words(parse("cc-html1K,ws=t")) and not V.splits_at_words(parse("cc-html1K,ws=t"), ["<mask>"])
    assert not V.splits_at_words(parse("cc-html1K,sw=f")) and not V.splits_at_words(V.VocabSpec(9, join_spaces=False))


@pytest.mark.parametrize("kept", [1 << 20, 400, 40])
def test_a_task_gathers_bounded_words(monkeypatch, kept):
    monkeypatch.setattr(W, "KEPT_BYTES", kept)
    draw = random.Random(1)
    texts = [None if draw.random() < 0.1 else " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randrange(9))) for _ in range(300)]
    whole = [draw.choice([True, False, None]) for _ in texts]
    cut = [t if t and not w and draw.random() < 0.5 else None for t, w in zip(texts, whole, strict=True)]
    rows = pa.record_batch([pa.array(texts, pa.string()), pa.array(whole, pa.bool_()), pa.array(cut, pa.string())], names=["text", "whole", "cut"])
    n, k = Counter(), Counter()
    for b in W._word_rows(rows[at : at + 30] for at in range(0, 300, 30)):
        for word, often, also in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n[word] += often
            k[word] += also
    assert n == Counter(w for t in texts for w in (t or "").split())
    assert +k == Counter(w for t, x, c in zip(texts, whole, cut, strict=True) for w in ((t if x else c) or "").split())


@pytest.mark.parametrize("pieces,by_words", [(["▁", "a", "b", "ab", "▁a"], True), (["a", "b", "ab", "▁a"], False)])
def test_triage_of_words_is_the_triage_of_texts(spark, pieces, by_words):
    """Without a piece for the mark, unknown characters of several words are one token."""
    voc = spark.createDataFrame([(0, "<unk>", 0.0, "UNKNOWN"), (9, "<mask>", 0.0, "USER_DEFINED"), *((k + 1, p, -1.0 - k, "NORMAL") for k, p in enumerate(pieces))], V.VOCAB_SCHEMA)
    docs = spark.createDataFrame([(t,) for t in ["ab xyz ab", "xx  yy a", "x <mask>ab<mask> y", None, "", *["a b xy zab"] * 500]], "text string").checkpoint()
    words = V.corpus_words(docs).checkpoint()
    assert words.count() < 20
    rows = [r for d in V.tokenize(docs, voc, "cc-html1K").collect() for r in zip(d.tokens, d.input_ids, strict=True)]
    least = len(pieces) + 10.0
    bits = sum(least * len(t) if k == 0 else k % 9 for t, k in rows) / math.log(2)
    chars = sum(len(r.text or "") for r in docs.collect())
    for known in (None, words):
        found = V.vocab_triage(docs, {"cc-html1K": voc}, words=known).first()
        assert found.tokens_per_char == pytest.approx(len(rows) / chars) and found.bits_per_char == pytest.approx(bits / chars)
    assert V._encoder(voc, 100)[0].value.parts_at(V.SPACE) == by_words


def test_reduced_lattices_are_those_of_the_pieces_left():
    draw = random.Random(6)
    for _ in range(30):
        pieces = sorted({*"abc▁", *("".join(draw.choice("abc▁") for _ in range(draw.randint(2, 5))) for _ in range(30))})
        texts = ["".join(draw.choice("abcd▁") for _ in range(draw.randint(0, 30))) for _ in range(25)]
        left = [k for k, p in enumerate(pieces) if len(p) == 1 or draw.random() < 0.4]
        number = np.full(len(pieces) + 1, -1, np.int32)
        number[left], number[-1] = np.arange(len(left)), len(left)
        block, order = Block.of(texts, Trie(pieces))
        fewer, same = Block.of(texts, Trie([pieces[k] for k in left]))
        got = Block.unpacked(Block.reduced(block.packed(), number))
        assert (order == same).all() and got.count.tolist() == fewer.count.tolist()
        score, weight = np.array([draw.uniform(-9, -1) for _ in range(len(left) + 1)]), np.array([draw.uniform(1, 5) for _ in texts])
        assert got.expected(score, weight, len(left)) == pytest.approx(fewer.expected(score, weight, len(left)))
        assert got.best_counts(score, weight, len(left)) == pytest.approx(fewer.best_counts(score, weight, len(left)))


def test_seeds_worth_as_much_as_the_last_are_taken_by_piece(spark):
    """No task gets all rows to choose from: those worth more are taken where they are."""
    draw = random.Random(2)
    rows = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(2, 6))) for _ in range(400)})
    found = [(p, float(draw.randint(2, 5))) for p in rows]
    df = spark.createDataFrame(found, "piece string, f double").repartition(4)
    want = sorted(found, key=lambda x: (-x[1] * len(x[0]), x[0]))
    for size in (1, 50, len(found) - 1):
        top = V._largest(df, F.col("f") * F.length("piece"), size)
        assert sorted(top.collect()) == sorted(want[:size])
