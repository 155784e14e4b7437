"""Tokenizer checks: parity with the public SentencePiece library on our learned vocabulary,
lossless round trip, and vocabulary shape."""

from pyspark.sql import functions as F

from corpusforge.operators import vocab as V
from corpusforge.plans import fixtures as fx
from corpusforge.plans.q_vocab import SPEC, learned_vocab
from tests.conftest import SF_SMALL


def _sp_model(rows):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    types = {"NORMAL": 1, "UNKNOWN": 2, "CONTROL": 3, "USER_DEFINED": 4}
    for r in rows:
        p = m.pieces.add()
        p.piece, p.score, p.type = r["piece"], r["score"], types[r["type"]]
    m.trainer_spec.model_type = 1
    m.trainer_spec.vocab_size = len(rows)
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, 1, 2, 3
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = True
    m.normalizer_spec.escape_whitespaces = True
    return spm.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_vocabulary_shape(spark):
    voc = learned_vocab(spark, SF_SMALL)
    rows = voc.orderBy("id").collect()
    assert len(rows) == V.VocabSpec.parse(SPEC).size
    assert [(r["piece"], r["type"]) for r in rows[:5]] == V.SPECIALS
    assert [r["id"] for r in rows] == list(range(len(rows)))
    assert all(r["piece"] for r in rows) and len({r["piece"] for r in rows}) == len(rows)
    assert max(len(r["piece"]) for r in rows) <= V.MAX_PIECE_LEN


def test_parity_with_sentencepiece(spark):
    voc = learned_vocab(spark, SF_SMALL)
    sp = _sp_model(voc.orderBy("id").collect())
    docs = fx.table(spark, SF_SMALL, "documents").select("doc_id", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))
    ours = {r["doc_id"]: (r["text"], r["input_ids"]) for r in V.tokenize(docs, voc, SPEC).collect()}
    mismatched = [k for k, (t, ids) in ours.items() if sp.encode(t) != ids]
    assert not mismatched, mismatched[:5]


def test_round_trip_is_lossless(spark):
    voc = learned_vocab(spark, SF_SMALL)
    docs = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    tok = V.tokenize(docs, voc, SPEC)
    back = tok.select(V.detokenize(F.col("tokens")).alias("back"), F.regexp_replace(F.trim("text"), r"\s+", " ").alias("norm"))
    assert back.where(F.col("back") != F.col("norm")).count() == 0
    assert tok.where(F.size("input_ids") != F.size("attention_mask")).count() == 0


def test_learner_quality_close_to_sentencepiece_trainer(spark):
    """Bits per character of our learned vocabulary vs one trained by the public library on the same text."""
    import io
    import math

    import sentencepiece as spm

    texts = [r["text"] for r in V.corpus_text(fx.table(spark, SF_SMALL, "documents").select("text")).collect()]
    buf = io.BytesIO()
    spm.SentencePieceTrainer.train(
        sentence_iterator=iter(texts), model_writer=buf, vocab_size=V.VocabSpec.parse(SPEC).size, model_type="unigram",
        max_sentence_length=32768, max_sentencepiece_length=64, control_symbols=["<pad>"], user_defined_symbols=["<mask>"],
        normalization_rule_name="identity", num_threads=4, minloglevel=2,
    )
    sp = spm.SentencePieceProcessor(model_proto=buf.getvalue())
    bits = sum(sum(-sp.get_score(i) for i in sp.encode(" ".join(t.split()))) for t in texts) / math.log(2)
    theirs = bits / sum(len(t) for t in texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    ours = V.vocab_triage(docs, {SPEC: learned_vocab(spark, SF_SMALL)}).collect()[0]["bits_per_char"]
    assert ours <= theirs * 1.05, (ours, theirs)


def test_classifier_beats_majority(spark):
    """M3 property: on held-out rows the classifier beats always predicting the majority class."""
    from corpusforge.plans.catalog import all_queries
    from tests.conftest import SF_MID

    qs = all_queries()
    metrics = {r["split"]: r for r in qs["text_classifier"].build(spark, SF_MID).collect()}
    data = qs["labelled_dataset"].build(spark, SF_MID)
    for split in ("validation", "test"):
        counts = [r["count"] for r in data.where(F.col("split") == split).groupBy("label").count().collect()]
        majority = max(counts) / sum(counts)
        assert metrics[split]["acc"] > majority and metrics[split]["mcc"] > 0


def test_parity_on_special_and_unknown_text(spark):
    voc = learned_vocab(spark, SF_SMALL)
    sp = _sp_model(voc.orderBy("id").collect())
    texts = ["a <unk> b", "x<mask>y <mask>", "ÿÿ ÆØ ŁŁŁ end", "12345 67", "<s> </s> <pad>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ours = {r["doc_id"]: r["input_ids"] for r in V.tokenize(df, voc, SPEC).collect()}
    for i, t in enumerate(texts):
        assert ours[i] == sp.encode(t), (t, ours[i], sp.encode(t))
