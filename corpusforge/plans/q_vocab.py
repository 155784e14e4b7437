"""Vocabulary, tokenization and training-table queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.operators import batching as B
from corpusforge.operators import split as S
from corpusforge.operators import vocab as V
from corpusforge.operators.labels import labelled_dataset
from corpusforge.plans import fixtures as fx
from corpusforge.plans.q_batching import _labelled_src
from corpusforge.plans.registry import register
from corpusforge.session import ensure_checkpoint_dir
from corpusforge.sources.sinks import materialize

SPEC = "cc-html1K"
TRIAGE_SPECS = ("cc-html1K", "cc-html1K,sd=t")
SEQ_LEN = 512
CLS_MAX_LEN = 128
LM_BUCKETS = None  # by the number of rows
# Fixed value from the reference: LM blocks held out for evaluation.
LM_HOLDOUT = 4096


def _spread(df):
    """Over all cores before Python work: the small tables come in fewer splits."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def learned_vocab(spark, sf, spec: str = SPEC, source: str = "documents", text: str = "text", words=None):
    """Vocabulary learned from a table, written once to the checkpoint folder and reused (K2)."""
    key = hashlib.md5(f"{sf}|{source}|{text}|{spec}".encode()).hexdigest()[:16]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vocab/{key}"
    return materialize(spark, path, lambda: V.learn_vocab(fx.table(spark, sf, source).select(text), spec, text, words=words))


@register("vocab_learn", "M2 M1 T8 J6 K2 K3")
def q_vocab_learn(spark, sf):
    _report, voc = V.audit_specials(learned_vocab(spark, sf))
    return voc


@register("vocab_learn_html", "M2 M1 (HTML corpus)")
def q_vocab_learn_html(spark, sf):
    """The vocabulary learned from page HTML, as the LM blocks use it."""
    return learned_vocab(spark, sf, SPEC, source="pages", text="html")


@register("tokenize", "T9 T7")
def q_tokenize(spark, sf):
    docs = _spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    tok = V.tokenize(docs, learned_vocab(spark, sf), SPEC, max_length=SEQ_LEN)
    return tok.select("doc_id", F.size("input_ids").alias("n_tokens"), "input_ids")


_WORD_VOCAB = f"""
w AS (SELECT unnest(string_split(text, ' ')) AS piece FROM documents),
voc AS (SELECT piece, CAST(('0x' || substr(md5(piece), 1, 7)) AS BIGINT) AS id FROM w GROUP BY piece HAVING count(*) >= 2)
"""


def word_vocab(spark, sf):
    """Word pieces seen at least twice; id = first 7 hex digits of md5(piece) (F-TOK)."""
    d = fx.table(spark, sf, "documents")
    w = d.select(F.explode(F.split("text", " ")).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return w.where(F.col("n") >= 2).select("piece", F.conv(F.substring(F.md5("piece"), 1, 7), 16, 10).cast("bigint").alias("id"))


@register(
    "token_ids",
    "J5",
    f"""WITH {_WORD_VOCAB.strip()},
ex AS (SELECT doc_id, i, string_split(text, ' ')[i] AS piece FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, ' ')) + 1)) AS i))
SELECT doc_id, array_to_string(list(coalesce(voc.id, 0) ORDER BY i), ' ') AS ids
FROM ex LEFT JOIN voc USING (piece) GROUP BY doc_id""",
)
def q_token_ids(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    ids = V.pieces_to_ids(docs, word_vocab(spark, sf), "doc_id", unk_id=0)
    return ids.select("doc_id", F.array_join("ids", " ").alias("ids"))


@register(
    "token_pieces",
    "J5",
    f"""WITH {_WORD_VOCAB.strip()},
once AS (SELECT id, min(piece) AS piece FROM voc GROUP BY id),
ex AS (SELECT doc_id, i, ids[i] AS id FROM (SELECT doc_id, list_append(list_transform(string_split(text, ' '), lambda w: CAST(('0x' || substr(md5(w), 1, 7)) AS BIGINT)), -1) AS ids FROM documents),
  LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i))
SELECT doc_id, md5(array_to_string(list(coalesce(once.piece, '?') ORDER BY i), ' ')) AS pieces_md5, count(once.piece) AS n_known
FROM ex LEFT JOIN once USING (id) GROUP BY doc_id""",
)
def q_token_pieces(spark, sf):
    """Ids of all words, also of those outside the vocabulary and of one no vocabulary has, looked up as pieces."""
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint")
    docs = fx.table(spark, sf, "documents").select("doc_id", F.array_append(F.transform(F.split("text", " "), number), F.lit(-1).cast("bigint")).alias("ids"))
    voc = word_vocab(spark, sf).groupBy("id").agg(F.min("piece").alias("piece"))
    got = V.ids_to_pieces(docs, voc, "doc_id", "ids")
    known = F.size(F.filter("pieces", lambda p: p.isNotNull())).cast("bigint")
    return got.select("doc_id", F.md5(F.array_join("pieces", " ", "?")).alias("pieces_md5"), known.alias("n_known"))


@register(
    "detokenize",
    "T10",
    f"""SELECT doc_id, substr(replace(array_to_string(list_transform(string_split(text, ' '), lambda w: '{V.SPACE}' || w), ''), '{V.SPACE}', ' '), 2) AS text
FROM documents""",
)
def q_detokenize(spark, sf):
    d = fx.table(spark, sf, "documents")
    pieces = F.transform(F.split("text", " "), lambda w: F.concat(F.lit(V.SPACE), w))
    return d.select("doc_id", V.detokenize(pieces).alias("text"))


@register("vocab_triage", "A18")
def q_vocab_triage(spark, sf):
    docs = fx.table(spark, sf, "documents").select("text")
    words = V.corpus_words(docs).checkpoint(eager=True)  # the vocabularies are learned from and judged by the same words
    return V.vocab_triage(docs, {s: learned_vocab(spark, sf, s, words=words) for s in TRIAGE_SPECS}, words=words)


@register("lm_blocks", "C3 S5 P1 T9 E1 E2 E3 P2")
def q_lm_blocks(spark, sf):
    html = _spread(fx.table(spark, sf, "pages").select("page_id", "html"))  # S5: only the html column is read
    voc = learned_vocab(spark, sf, SPEC, source="pages", text="html")  # an HTML vocabulary for HTML blocks
    tok = V.tokenize(html, voc, SPEC, text="html").drop("html", "tokens")
    batched = B.with_batches(tok, "page_id", buckets=LM_BUCKETS)
    blocks = B.pack_blocks(batched, SEQ_LEN)
    keyed = blocks.withColumn("block_key", F.concat_ws(":", "bucket", "batch", "block"))
    # P1's shuffle is the salted-hash order the batches are formed in; P2 holds out 4,096 blocks
    out = S.holdout(keyed, "block_key", LM_HOLDOUT, materialize=True)
    return out.select("bucket", "batch", "block", "input_ids", "attention_mask", "labels", "split")


@register("classification_dataset", "C4 S6 T9 E5 J7 P3")
def q_classification_dataset(spark, sf):
    data, _dictionary = labelled_dataset(_labelled_src(spark, sf), "doc_id", "text", "label_name")
    tok = V.tokenize(data, learned_vocab(spark, sf), SPEC, text="sentence", max_length=CLS_MAX_LEN).drop("sentence", "tokens")
    batched = B.with_batches(tok, "doc_id", buckets=LM_BUCKETS)
    padded = B.truncate_pad(batched.drop("attention_mask"), CLS_MAX_LEN, pad_to="batch", pad_id=3)
    return padded.select("doc_id", "label", "label_name", "split", "input_ids", "attention_mask")


@register("text_classifier", "M3 A11 C5")
def q_text_classifier(spark, sf):
    from corpusforge.operators import metrics as M
    from corpusforge.operators.classifier import fit_text_classifier, predict_scores

    data, _dictionary = labelled_dataset(_labelled_src(spark, sf), "doc_id", "text", "label_name")
    tok = V.tokenize(data, learned_vocab(spark, sf), SPEC, text="sentence", max_length=SEQ_LEN).drop("sentence")
    tok = tok.checkpoint(eager=True)
    model = fit_text_classifier(tok.where(F.col("split") == "train"))
    scored = predict_scores(model, tok)
    return M.evaluate(scored, scores="scores", ref="label", by=["split"])


#: Units end at white space only, so SQL can cut them.
PLANTED_SPEC = "cc-html1K,su=f,sn=f"

# A vocabulary by rule: every character of the text, and the starts of two to four characters of units seen twice; scores are whole numbers.
_PLANTED = f"""
unit AS (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' '), lambda w: '{V.SPACE}' || w)) AS u FROM documents),
word AS (SELECT u, count(*) AS c FROM unit GROUP BY u),
piece AS (SELECT DISTINCT p FROM (
  SELECT unnest(string_split(u, '')) AS p FROM word
  UNION ALL SELECT unnest([substr(u, 1, 2), substr(u, 1, 3), substr(u, 1, 4), substr(u, 2, 3)]) FROM word WHERE c >= 2 AND length(u) >= 4)),
voc AS MATERIALIZED (SELECT map(list(p), list(-1.0 - CAST(('0x' || substr(md5(p), 1, 1)) AS INTEGER))) AS m FROM piece),
best AS (
  SELECT u, c, 0 AS k, [CAST(0 AS DOUBLE)] AS top FROM word
  UNION ALL
  SELECT u, c, k + 1, list_append(top, list_max(list_filter(list_transform(range(greatest(1, k - 2), k + 2), lambda s: top[s] + m[substr(u, s, k + 2 - s)]), lambda x: x IS NOT NULL)))
  FROM best, voc WHERE k < length(u)),
scored AS (SELECT u, c, top[k + 1] AS score FROM best WHERE k = length(u))
"""


def planted_vocab(spark, sf):
    """(id, piece, score, type) by the rule of ``_PLANTED``."""
    units = V.presplit(F.col("text"), V.VocabSpec.parse(PLANTED_SPEC))
    word = _spread(fx.table(spark, sf, "documents").select("text")).select(F.explode(units).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    starts = F.array(*[F.substring("u", a, n) for a, n in ((1, 2), (1, 3), (1, 4), (2, 3))])
    often = F.when((F.col("c") >= 2) & (F.length("u") >= 4), starts).otherwise(F.array().cast("array<string>"))
    piece = word.select(F.explode(F.concat(F.split("u", "(?!^)"), often)).alias("piece")).distinct()  # words are counted once
    score = -1.0 - F.conv(F.substring(F.md5("piece"), 1, 1), 16, 10).cast("float")
    special = spark.createDataFrame([(i, p, 0.0, t) for i, (p, t) in enumerate(V.SPECIALS)], V.VOCAB_SCHEMA)
    number = (F.row_number().over(Window.orderBy("piece")) + len(V.SPECIALS) - 1).cast("int")  # a vocabulary has one task's size
    return special.unionByName(piece.select(number.alias("id"), "piece", score.cast("float").alias("score"), F.lit("NORMAL").alias("type")))


@register(
    "tokenize_planted",
    "T9 T8",
    f"""WITH RECURSIVE {_PLANTED.strip()}
SELECT doc_id, sum(score) AS score, CAST(sum(length(unit.u)) AS BIGINT) AS n_chars FROM unit JOIN scored ON unit.u = scored.u GROUP BY doc_id""",
)
def q_tokenize_planted(spark, sf):
    """The score of every document's segmentation under a planted vocabulary: the best path, found in SQL by recursion."""
    voc = planted_vocab(spark, sf).checkpoint(eager=True)
    tok = V.tokenize(_spread(fx.table(spark, sf, "documents").select("doc_id", "text")), voc, PLANTED_SPEC)
    pairs = tok.select("doc_id", F.explode(F.arrays_zip("tokens", "input_ids")).alias("p")).select("doc_id", F.length("p.tokens").alias("n"), F.col("p.input_ids").alias("id"))
    # every task has the vocabulary as it is; dealt by id, all tokens of a frequent piece would meet in one task
    scored = pairs.join(F.broadcast(voc.select("id", F.col("score").cast("double").alias("score"))), "id")
    return scored.groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("n").cast("bigint").alias("n_chars"))


@register(
    "vocab_triage_planted",
    "A18",
    f"""WITH RECURSIVE {_PLANTED.strip()}
SELECT '{PLANTED_SPEC}' AS vocab, round(-sum(score * c) / ln(2.0) / (SELECT sum(length(text)) FROM documents), 9) AS bits_per_char FROM scored""",
)
def q_vocab_triage_planted(spark, sf):
    """Bits per character of a planted vocabulary."""
    docs = _spread(fx.table(spark, sf, "documents").select("text"))
    got = V.vocab_triage(docs, {PLANTED_SPEC: planted_vocab(spark, sf).checkpoint(eager=True)})
    return got.select("vocab", F.round("bits_per_char", 9).alias("bits_per_char"))
