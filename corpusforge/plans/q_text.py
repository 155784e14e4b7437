"""Text trimming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.text import MAX_SENTENCE_BYTES, btrim, has_reserved_mark, strim
from corpusforge.operators import vocab_stats as vs
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register
from corpusforge.plans.sqlgen import btrim_recursive_sql, strim_sql

STRIM_SIZE = 64
BTRIM_SIZE = 1024
SEQ_LEN = 512

_WORD_VOCAB_SQL = """
words AS (SELECT unnest(string_split(text, ' ')) AS piece FROM documents),
counts AS (SELECT piece, count(*) AS n FROM words WHERE piece <> '' GROUP BY piece),
tot AS (SELECT sum(n) AS total FROM counts),
voc AS (SELECT piece, n, ln(n) - ln(total) AS score FROM counts, tot),
raw AS (SELECT sum(CASE WHEN length(piece) * exp(score) < 1 THEN length(piece) * exp(score) ELSE 0 END) AS raw FROM voc)
"""


@register("strim", "T5", f"SELECT doc_id, {strim_sql('text', str(STRIM_SIZE))} AS text FROM documents")
def q_strim(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", strim(F.col("text"), STRIM_SIZE).alias("text"))


@register("btrim", "T6", btrim_recursive_sql("SELECT doc_id, text FROM documents", "doc_id", "text", BTRIM_SIZE))
def q_btrim(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", btrim(F.col("text"), BTRIM_SIZE).alias("text"))


_VOCAB_CORPUS_SQL = btrim_recursive_sql(fx.MARKED_DOCUMENTS_SQL, "doc_id", "text", MAX_SENTENCE_BYTES)
_VOCAB_CORPUS_SQL = f"SELECT doc_id, text FROM ({_VOCAB_CORPUS_SQL}) WHERE NOT contains(text, chr(9605))"


@register("vocab_corpus", "M1 T6 B5", _VOCAB_CORPUS_SQL)
def q_vocab_corpus(spark, sf):
    d = fx.marked_documents(spark, sf)
    return d.select("doc_id", btrim(F.col("text"), MAX_SENTENCE_BYTES).alias("text")).where(~has_reserved_mark(F.col("text")))


@register("avg_token_len", "A12", f"WITH {_WORD_VOCAB_SQL.strip()}\nSELECT round({vs.TRIM_FACTOR} * raw, 6) AS avg_tok_len FROM raw")
def q_avg_token_len(spark, sf):
    voc = vs.word_vocabulary(fx.table(spark, sf, "documents"))
    return vs.avg_token_len_col(voc).select(F.round(F.lit(vs.TRIM_FACTOR) * F.col("raw"), 6).alias("avg_tok_len"))


@register(
    "prefix_trim",
    "T7",
    f"WITH {_WORD_VOCAB_SQL.strip()}\nSELECT doc_id, substr(text, 1, CAST(ceil({SEQ_LEN} * {vs.TRIM_FACTOR} * (SELECT raw FROM raw)) AS BIGINT)) AS text FROM documents",
)
def q_prefix_trim(spark, sf):
    docs = fx.table(spark, sf, "documents")
    hint = vs.avg_token_len(vs.word_vocabulary(docs))
    return vs.trim_for_encoding(docs.select("doc_id", "text"), SEQ_LEN, hint)


@register(
    "trim_calibration",
    "A17",
    f"""WITH {_WORD_VOCAB_SQL.strip()}
SELECT round(quantile_disc(length(array_to_string(string_split(text, ' ')[1:{SEQ_LEN}], ' ')) / ({SEQ_LEN} * (SELECT raw FROM raw)), 0.95), 6) AS factor
FROM documents""",
)
def q_trim_calibration(spark, sf):
    docs = fx.table(spark, sf, "documents")
    raw = vs.avg_token_len(vs.word_vocabulary(docs), factor=1.0)
    return vs.trim_calibration(docs, raw, SEQ_LEN).select(F.round("factor", 6).alias("factor"))
