"""Batching, packing, truncation and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.hashing import row_hash_sql
from corpusforge.operators import batching as B
from corpusforge.operators import labels as L
from corpusforge.operators import split as S
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register

BUCKETS = 4  # pinned so the oracle SQL can spell the bucket rule; the library default follows the session
BLOCK = 512
# Fixed values from the reference: the block lengths compared across model sizes (256 doubled three times).
SIZES = (256, 512, 1024, 2048)
MAX_LEN = 128
HOLDOUT = 4096  # fixed value from the reference: the exact-count holdout

_TOK = f"""
tok AS ({fx.WORD_TOKENS_SQL.strip()}),
hb AS (SELECT doc_id, input_ids, {row_hash_sql('doc_id')} AS h FROM tok),
bt AS (SELECT doc_id, input_ids, h, CAST(h % {BUCKETS} AS INTEGER) AS bucket,
         row_number() OVER (PARTITION BY h % {BUCKETS} ORDER BY h, doc_id) AS rn FROM hb),
bb AS (SELECT *, CAST((rn - 1) // {B.BATCH_SIZE} AS INTEGER) AS batch FROM bt)
"""


def _tokens(spark, sf):
    t = fx.word_tokens(spark, sf)
    return B.with_batches(t, "doc_id", buckets=BUCKETS).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))
    )


@register("batching", "E1 P4", f"WITH {_TOK.strip()}\nSELECT doc_id, bucket, CAST(rn AS INTEGER) AS rn, batch FROM bb")
def q_batching(spark, sf):
    return _tokens(spark, sf).select("doc_id", "bucket", "rn", "batch")


def _pack_sql(sizes) -> str:
    vals = ", ".join(f"({s})" for s in sizes)
    return f"""WITH {_TOK.strip()},
cat AS (SELECT bucket, batch, flatten(list(input_ids ORDER BY rn)) AS toks FROM bb GROUP BY bucket, batch),
sz AS (SELECT * FROM (VALUES {vals}) v(block_size)),
nb AS (SELECT bucket, batch, block_size, toks,
          CASE WHEN len(toks) >= block_size THEN len(toks) // block_size ELSE 1 END AS n_blocks
       FROM cat, sz WHERE len(toks) > 0),
bl AS (SELECT bucket, batch, block_size, toks, unnest(range(0, n_blocks)) AS block FROM nb)
SELECT bucket, batch, CAST(block_size AS INTEGER) AS block_size, CAST(block AS INTEGER) AS block,
  array_to_string(toks[block * block_size + 1 : (block + 1) * block_size], ' ') AS ids,
  CAST(len(toks[block * block_size + 1 : (block + 1) * block_size]) AS INTEGER) AS n
FROM bl"""


def _packed_view(df):
    return df.select(
        "bucket", "batch", F.col("block_size").cast("int").alias("block_size"), F.col("block").cast("int").alias("block"),
        F.array_join("input_ids", " ").alias("ids"), F.size("labels").alias("n"),
    )


@register("block_packing", "E2 E3", _pack_sql([BLOCK]))
def q_block_packing(spark, sf):
    return _packed_view(B.pack_blocks(_tokens(spark, sf), BLOCK))


@register("multi_length_packing", "E4", _pack_sql(SIZES))
def q_multi_length_packing(spark, sf):
    return _packed_view(B.pack_blocks(_tokens(spark, sf), list(SIZES)))


@register(
    "truncate_pad",
    "E5",
    f"""WITH {_TOK.strip()},
cut AS (SELECT doc_id, bucket, batch, input_ids[1:{MAX_LEN}] AS ids FROM bb),
mx AS (SELECT *, max(len(ids)) OVER (PARTITION BY bucket, batch) AS to_len FROM cut)
SELECT doc_id, array_to_string(list_resize(ids, to_len, 0), ' ') AS ids,
  array_to_string(list_resize(list_transform(ids, lambda x: 1), to_len, 0), ' ') AS mask FROM mx""",
)
def q_truncate_pad(spark, sf):
    t = B.truncate_pad(_tokens(spark, sf).drop("attention_mask"), MAX_LEN, pad_to="batch", pad_id=0)
    return t.select("doc_id", F.array_join("input_ids", " ").alias("ids"), F.array_join("attention_mask", " ").alias("mask"))


@register("shuffle", "P1", f"SELECT doc_id, {row_hash_sql('doc_id')} AS h FROM documents")
def q_shuffle(spark, sf):
    return S.shuffle(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")


@register(
    "holdout_exact",
    "P2",
    f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {row_hash_sql('event_id')}, event_id) <= {HOLDOUT}
  THEN 'test' ELSE 'train' END AS split FROM events""",
)
def q_holdout_exact(spark, sf):
    return S.holdout(fx.table(spark, sf, "events").select("event_id"), "event_id", HOLDOUT)


def _auto_split_sql(source: str, key: str, cols: str) -> str:
    return f"""
WITH src AS ({source}),
r1 AS (SELECT *, row_number() OVER (ORDER BY {row_hash_sql(key)}, {key}) AS k1, count(*) OVER () AS n FROM src),
held AS (SELECT *, row_number() OVER (ORDER BY {row_hash_sql(key, '54321:2')}, {key}) AS k2 FROM r1 WHERE k1 <= ceil(n / 8.0)),
hc AS (SELECT count(*) AS nh FROM held)
SELECT {cols}, 'train' AS split FROM r1 WHERE k1 > ceil(n / 8.0)
UNION ALL SELECT {cols}, CASE WHEN k2 <= ceil((SELECT nh FROM hc) / 2.0) THEN 'test' ELSE 'validation' END FROM held"""


@register("auto_split", "P3", _auto_split_sql("SELECT doc_id FROM documents", "doc_id", "doc_id"))
def q_auto_split(spark, sf):
    return S.auto_split(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")


_LABELLED_SRC = """SELECT d.doc_id, d.text AS sentence,
  CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label_name
FROM documents d JOIN labels l USING (doc_id)"""


def _labelled_src(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    lab = fx.table(spark, sf, "labels")
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return d.join(lab.select("doc_id", name.alias("label_name")), "doc_id")


@register(
    "label_dictionary",
    "J7",
    f"SELECT CAST(row_number() OVER (ORDER BY label_name) - 1 AS INTEGER) AS label_id, label_name "
    f"FROM (SELECT DISTINCT label_name FROM ({_LABELLED_SRC}))",
)
def q_label_dictionary(spark, sf):
    return L.label_dictionary(_labelled_src(spark, sf))


@register(
    "labelled_dataset",
    "S6 J7 P3",
    f"""WITH lab AS ({_LABELLED_SRC}),
dict AS (SELECT CAST(row_number() OVER (ORDER BY label_name) - 1 AS INTEGER) AS label, label_name FROM (SELECT DISTINCT label_name FROM lab)),
sp AS ({_auto_split_sql('SELECT doc_id FROM lab', 'doc_id', 'doc_id')})
SELECT lab.doc_id, lab.sentence, dict.label, lab.label_name, sp.split FROM lab JOIN dict USING (label_name) JOIN sp USING (doc_id)""",
)
def q_labelled_dataset(spark, sf):
    out, _ = L.labelled_dataset(_labelled_src(spark, sf), "doc_id", "text", "label_name")
    return out.select("doc_id", "sentence", "label", "label_name", "split")
