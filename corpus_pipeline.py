"""The training-data pipeline: stages over ``documents``, each one written as Parquet and read again.

Every stage takes all its predecessor kept, and all but the last return the columns of
``documents``.  Rows with a null id or a null text pass through every stage's operator as its
docstring says: a null text is rejected by language ID, a null id is nobody's duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import language_id, packing, pii, quality_rules, simhash
from corpusforge.llm.common import fresh, table, written
from corpusforge.llm.queries import vocabulary
from corpusforge.session import prepare

#: Trained networks and merge vocabularies: the rows of the last stage cannot be expressed in SQL.
ORACLE_SQL = None

#: A document whose best language has less than this mean probability is rejected (short clean ones come down to 0.37).
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; those without a letter, or between all languages, go."""
    prepare(spark)
    name = fresh(docs, "language")
    found = docs.withColumn(name, language_id.predicted(language_id.learn(docs)))
    kept = found.where((F.col(f"{name}.lang") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and are more likely good than not."""
    prepare(spark)
    judged, name = quality_rules.judge_quality(spark, docs)
    return judged.where(F.col(f"`{name['kept']}`")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near texts the one with the smallest id stays, and one of the rows that repeat an id with its text.

    A row is judged by its id and text, so different texts under one id do not stand for each other.
    """
    prepare(spark)
    own = fresh(docs, "text_hash")
    docs = docs.withColumn(own, F.xxhash64("text"))
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id"), F.col(own).alias("text_hash")))
    found = written(spark, simhash.near_duplicates(spark, docs.select(key.alias("key"), "text"), id_col="key")).where("key is not null")
    pair = [F.col("key.doc_id").alias("doc_id"), F.col("key.text_hash").alias(own)]
    dropped = found.where("key <> component_id").select(*pair).distinct()
    repeated = written(spark, found.groupBy("key").count().where("count > 1").select(*pair))
    left = docs.join(dropped, ["doc_id", own], "left_anti")
    single = left.join(repeated, ["doc_id", own], "left_anti")
    once = left.join(repeated, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
    return single.unionByName(once).select(*(c for c in docs.columns if c != own))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; ``n_chars`` counts the new text."""
    prepare(spark)
    out = docs.withColumn("text", pii.masked(pii.learn(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of packed sequences."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the checkpoint folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(spark, docs)
    return docs
