"""The unigram learner against plain loops: repeated substrings, lattices, normalization, switches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.normalizer import normalize_text, normalized
from corpusforge.functions.unigram import Lattice
from corpusforge.operators import vocab as V
from corpusforge.operators.unigram_learner import Block, Trie, repeated_substrings
from corpusforge.plans import fixtures as fx
from tests.conftest import SF_SMALL


def brute_repeats(counts, longest):
    """Right-maximal substrings with a count of two or more."""
    f = {}
    for unit, c in counts:
        for i in range(len(unit)):
            for j in range(i + 1, min(i + longest, len(unit)) + 1):
                f[unit[i:j]] = f.get(unit[i:j], 0) + c
    longer = {}
    for s, c in f.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), c)
    return {s: c for s, c in f.items() if c >= 2 and longer.get(s, 0) < c}


def found_repeats(counts, longest, partitions):
    rows = repeated_substrings(counts, longest, partitions).collect()
    out = {r.piece: r.f for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeated_substrings_equal_brute_force(spark, monkeypatch, partitions):
    draw = random.Random(partitions)
    counts = {"".join(draw.choice("ab▁é\U0001f600") for _ in range(draw.randint(1, 20))): float(draw.randint(1, 4)) for _ in range(300)}
    counts["c" * 200] = 1.0  # longer than any piece: windows over it overlap
    table = spark.createDataFrame(list(counts.items()), "unit string, c double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert found_repeats(table, 6, partitions) == brute_repeats(counts.items(), 6)
        assert found_repeats(table.limit(0), 6, partitions) == {}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("spec", ["cc-html1K", "cc-html1K,sw=f"])
def test_seeds_of_a_table_equal_brute_force(spark, spec):
    docs = fx.table(spark, SF_SMALL, "documents").select("text").where("length(text) < 3000")
    counts = V.unit_counts(docs, V.VocabSpec.parse(spec)).checkpoint()
    rows = [(r.unit, r.c) for r in counts.collect()]
    assert found_repeats(counts, V.MAX_PIECE_LEN, 8) == brute_repeats(rows, V.MAX_PIECE_LEN)
    top = V.seed_pieces(counts, V.VocabSpec.parse(spec), 50)
    want = sorted(((s, c) for s, c in brute_repeats(rows, V.MAX_PIECE_LEN).items() if len(s) > 1), key=lambda x: (-x[1] * len(x[0]), x[0].encode()))
    assert sorted(top) == sorted(want[:50])


def test_lattices_equal_the_plain_ones():
    draw = random.Random(1)
    for _ in range(60):
        pieces = sorted({"".join(draw.choice("abc▁") for _ in range(draw.randint(1, 5))) for _ in range(30)})
        score = np.array([draw.uniform(-9, -1) for _ in pieces])
        texts = ["".join(draw.choice("abcd▁") for _ in range(draw.randint(1, 30))) for _ in range(25)]
        weight = np.array([draw.uniform(1, 5) for _ in texts])
        plain = Lattice({p: (k, s) for k, (p, s) in enumerate(zip(pieces, score, strict=True))})
        acc = {}
        for t, w in zip(texts, weight, strict=True):
            plain.expected_counts(t, w, acc)
        full = np.append(score, score.min() - 10)
        block, order = Block.of(texts, Trie(pieces))
        block = Block.unpacked(block.packed())
        texts, weight = [texts[k] for k in order], weight[order]
        got = block.expected(full, weight, len(pieces))
        assert got == pytest.approx([acc.get(p, [0, 0])[0] for p in pieces], abs=1e-9)
        assert block.best_counts(full, weight, len(pieces)) == pytest.approx([acc.get(p, [0, 0])[1] for p in pieces])
        top, _ = block.best(full)
        assert top[block.last] == pytest.approx([plain.viterbi(t)[2] for t in texts])
        # without the piece itself, and without pieces that are gone
        own, order = Block.of(pieces, Trie(pieces), whole=False)
        top, _ = own.best(full)
        for p, s in zip([pieces[k] for k in order], top[own.last], strict=True):
            want = plain.viterbi(p, exclude=p)[2]
            assert s == pytest.approx(want) or len(p) == 1
        gone = full.copy()
        gone[[k for k, p in enumerate(pieces) if len(p) == 3]] = -np.inf
        fewer = Lattice({p: (k, s) for k, (p, s) in enumerate(zip(pieces, score, strict=True)) if len(p) != 3})
        fewer.unk_score = full[-1]
        assert block.best(gone)[0][block.last] == pytest.approx([fewer.viterbi(t)[2] for t in texts])


def _library():
    import sentencepiece as spm

    return spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)


def test_normalization_equals_the_library(spark):
    library = _library()
    draw = random.Random(2)
    pool = [*"aeiouAy \t\n", *map(chr, range(0x300, 0x345)), *"ﬁＡＢ①éạậ각ｶﾞ～~½㎏▁", "ᄀ", "ᅡ", "ᆨ", "　", "​", "\x01", "\x7f", "\xa0", *(chr(draw.randrange(0x80, 0x3000)) for _ in range(300))]
    rows = ["ﬁne ＡＢ ①", "", "plain\x0b text\x1f\t", None, "é 각 ẹ́"]
    rows += ["".join(draw.choice(pool) for _ in range(draw.randrange(1, 15))) for _ in range(3000)]
    assert [normalized(t) for t in rows if t is not None] == [library.Normalize(t) for t in rows if t is not None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", normalize_text(F.col("t")).alias("n")).collect()
    for r in got:
        assert r.n is None if r.t is None else " ".join(r.n.split(" ")).translate(str.maketrans("\t\n\f\r", "    ")) == library.Normalize(r.t)


def test_whitespace_only_pieces(spark):
    """Indented text: with the switch runs of marks are pieces, without it none is."""
    draw = random.Random(3)
    lines = [" " * draw.choice([0, 4, 8]) + " ".join(draw.choice(["if", "then", "else", "x", "y"]) for _ in range(4)) for _ in range(3000)]
    docs = spark.createDataFrame([("\n".join(lines[k : k + 10]),) for k in range(0, 3000, 10)], "text string")
    marks = {}
    for name, allowed in (("with", True), ("without", False)):
        spec = V.VocabSpec(size=60, whitespace_only_pieces=allowed, join_spaces=False)
        voc = V.learn_vocab(docs, spec)
        pieces = [r.piece for r in voc.where("type = 'NORMAL'").collect()]
        assert not any(V.SPACE * 2 in p and p.strip(V.SPACE) for p in pieces)
        marks[name] = [p for p in pieces if set(p) == {V.SPACE} and len(p) > 1]
        tok = V.tokenize(docs, voc, spec)
        assert all("".join(r.tokens) == V.SPACE + r.text.replace(" ", V.SPACE).replace("\n", V.SPACE) for r in tok.collect())
    assert marks["with"] and not marks["without"]


@pytest.mark.parametrize("spec", ["sd=t", "sn=f", "sn=f,sw=f", "sn=f,ws=t", "su=f", "su=f,sn=f", "su=f,sw=f", "sw=f", "sw=f,sd=t", "sw=f,ws=t", "sw=f,ws=t,sd=t", "ws=t", "wo=t"])
def test_all_switches_learn_a_whole_vocabulary(spark, spec):
    order = ["su=f", "sn=f", "sw=f", "ws=t", "wo=t", "sd=t"]
    name = "cc-html1K," + ",".join(s for s in order if s in spec.split(","))
    docs = fx.table(spark, SF_SMALL, "documents").select("text").limit(120)
    voc = V.learn_vocab(docs, name)
    assert voc.count() <= 1024
    rows = V.tokenize(docs, voc, name).collect()
    for r in rows:
        text = " ".join(normalized(r.text or "").split())
        assert "".join(r.tokens).replace(V.SPACE, " ").strip() == text or V.UNK_PENALTY and "▅" in (r.text or "")
