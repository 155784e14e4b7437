"""The tokenizer operators against the libraries themselves."""

import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusforge.llm.packing import ByteLevelIds, TierPacker, pack_documents
from corpusforge.llm.piece_codec import PieceCodec, encode_decode
from corpusforge.llm.token_counts import _JsonCounter, _PieceCounter, count_tokens

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
EDGE = ["", " ", "  ", "\n", " \n", "a ", " a", "\u2581", "\u2581\u2581a", "a\u2581b", "<s>a</s>", "<0x0A>", "<|endoftext|> x<|endoftext|>", "\x1c a\x1d \x85b\xa0 c", "x" * 5000, "\U0001f44d\U0001f3fd \u200d\u0301", "a\r\n\tb"]


def texts(n=1500):
    draw = random.Random(2)
    chars = "abcde\u00e9\u00fc  \n\u2581 \t the of 123.,!?\u65e5\u672c\u8a9e\U0001f600\x00\u200d\xa0eeeeaaaa'"
    bits = ["<s>", "'s", "'re", " '", "<|endoftext|>", "<0x0A>", " the", "ing", "  ", "    ", "\n\n", "\u65e5\u672c", "\u00b2", "\u00bd", "\u00aa", "\x85", "http://", "  \n ", "\x1c", "\x1f ", "\u2028", "\u3000 ", "\u02bc", "\u2177", "\u0663"]
    out = list(EDGE)
    for _ in range(n):
        out.append("".join(draw.choice(chars) if draw.random() < 0.7 else draw.choice(bits) for _ in range(draw.randint(0, 40))))
        out.append("".join(draw.choice([*bits, "ab", "x"]) for _ in range(draw.randint(0, 20))))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    return texts() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_matches_the_library(sample, library):
    codec = PieceCodec(open(MODEL, "rb").read())
    for t in sample:
        ids = library.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode([*ids, codec.end_id]) == library.decode([*ids, codec.end_id])


def test_decoding_of_any_ids_matches_the_library(library):
    codec, draw = PieceCodec(open(MODEL, "rb").read()), random.Random(3)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(300)]) for _ in range(draw.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_last_tokens_of_all_prefixes(library):
    """The prefix table's claim: the encoding of a prefix ends in the table's token, and without it is the encoding of the shorter prefix."""
    codec = PieceCodec(open(MODEL, "rb").read())
    for text in ("understanding", "aaaaaaaaaaa", "internationalization", "\u00e9t\u00e9s"):
        for end in range(1, len(text) + 1):
            part = " " + text[:end]
            ids = codec.encode_part(part)
            assert ids == library.encode(text[:end])
            shorter = part[: len(part) - len(codec.piece[ids[-1]])]
            assert (codec.encode_part(shorter) if shorter else []) == ids[:-1]


def test_counts_match_the_libraries(sample, library):
    tok = Tokenizer.from_file(BYTES)
    assert _PieceCounter(open(MODEL, "rb").read()).counts(sample) == [len(library.encode(t)) for t in sample]
    assert _JsonCounter(open(BYTES, "rb").read()).counts(sample) == [len(tok.encode(t, add_special_tokens=False).ids) for t in sample]
    other = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(other)
    assert _JsonCounter(open(other, "rb").read()).counts(sample[:200]) == [len(tok.encode(t, add_special_tokens=False).ids) for t in sample[:200]]


def test_byte_level_ids_match_the_library(sample):
    tok, ids = Tokenizer.from_file(BYTES), ByteLevelIds(open(BYTES, "rb").read())
    for t in sample:
        assert ids(t) == b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids)


def rows_of(spark):
    rows = [(k, t) for k, t in enumerate(EDGE)] + [(1000, None), (None, "null id"), (7, " a"), (2000, "long words here " * 40000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("_id", F.lit(2))


def test_codec_operator(spark, library):
    rows, docs = rows_of(spark)
    got = sorted(((r.doc_id, r.ids, r.n_tokens, r.decoded) for r in encode_decode(docs, MODEL, batch_bytes=1000).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, " ".join(map(str, ids)), len(ids), library.decode(ids)))
    assert got == sorted(want, key=str)
    assert encode_decode(docs.limit(0), MODEL).count() == 0


def test_count_operator(spark, library):
    rows, docs = rows_of(spark)
    got = sorted((tuple(r) for r in count_tokens(docs, MODEL, batch_bytes=1000).collect()), key=str)
    n = [len(library.encode(t or "")) for _, t in rows]
    assert got == sorted(((i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(rows, n, strict=True)), key=str)
    assert count_tokens(docs.limit(0), MODEL).count() == 0


def check_pieces(rows, ids_of, window=1024):
    """Every id is in one piece, every sequence is gapless and as long as its tier."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        at, ids = 0, ids_of[doc]
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(raw)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_length"] <= window and at & (at - 1) == 0
    assert by_doc.keys() == ids_of.keys()
    return by_sequence


def test_packing_operator(spark):
    tok = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x y" * 30000)], docs.schema)).withColumn("offset", F.lit("x"))
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = [r.asDict() for r in pack_documents(docs, BYTES).collect()]
    sequences = check_pieces(rows, ids)
    groups = {}
    for pieces in sequences.values():
        groups[pieces[0]["step_group"]] = groups.get(pieces[0]["step_group"], 0) + pieces[0]["sequence_length"]
    full = sorted(groups.values())[len(groups) // 2]
    assert abs(full - 64 * 1024) <= 1024
    whole = sum(1 for d in ids if len(ids[d]) <= 1024 and sum(r["doc_id"] == d for r in rows) == 1)
    assert whole > 0.9 * sum(len(x) <= 1024 for x in ids.values())
    assert pack_documents(docs.limit(0), BYTES).count() == 0
    none = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")
    assert sum(r.length for r in pack_documents(none, BYTES).collect()) == 8


def test_tier_packer_on_random_lengths():
    draw = random.Random(9)
    packer, ids = TierPacker(3), {}
    for k in range(3000):
        n = int(draw.paretovariate(0.7))
        ids[k] = [draw.randrange(1 << 16) for _ in range(min(n, 5000))] + [0]
        packer.add(k, b"".join(i.to_bytes(4, "little") for i in ids[k]))
        if packer.held >= 500:
            packer.pack()
            assert packer.waiting < 1024
    packer.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    check_pieces([dict(zip(names, r, strict=True)) for r in packer.taken()], ids)
