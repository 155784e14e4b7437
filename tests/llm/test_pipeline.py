import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from corpusforge.llm import language_id, pii, quality_rules
from corpusforge.llm.common import written


def stage(spark, name, docs):
    out = dict(pipeline.STAGES)[name](spark, docs, "")
    if name != "packing":
        assert out.columns == docs.columns
    return written(spark, out)


def test_stages_one_after_another(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "1234 5678", "en", "s", 9), (-4, "a b c", "en", "s", 5)]
    docs = written(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)).unionByName(docs.where("doc_id = 3")))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))

    first = stage(spark, "language", docs)
    gone = {r.doc_id for r in docs.select("doc_id").subtract(first.select("doc_id")).collect()}
    assert {-1, -2, -3} <= gone and len(gone) < 0.01 * docs.count()
    assert first.where("doc_id = 3").count() == 2

    second = stage(spark, "quality", first)
    judged, name = quality_rules.judge_quality(spark, first)
    want = sorted(r.doc_id for r in judged.where(F.col(name["kept"])).select("doc_id").collect())
    assert sorted(r.doc_id for r in second.select("doc_id").collect()) == want
    kept = second.join(labels, "doc_id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in kept}[1] > 0.9 * labels.where("label = 1").count()

    third = stage(spark, "near_duplicates", second)
    from corpusforge.llm.simhash import near_duplicates

    groups = {}
    for r in near_duplicates(spark, second).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    left = [r.doc_id for r in third.select("doc_id").collect()]
    assert sorted(left) == sorted(min(g) for g in groups.values())
    texts = {r.doc_id: r.text for r in second.collect()}
    assert all(r.text == texts[r.doc_id] for r in third.collect())

    fourth = stage(spark, "personal_data", third)
    field = pii.learn(third)
    want = {r.doc_id: r.m for r in third.select("doc_id", pii.masked(field).alias("m")).collect()}
    got = {r.doc_id: r for r in fourth.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert any("<email>" in r.text for r in got.values()) and not any(pii.base_spans(r.text) for r in got.values())

    rows = stage(spark, "packing", fourth).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert pieces.keys() == got.keys()
    for i, found in pieces.items():
        n = len(tok.encode(got[i].text, add_special_tokens=False).ids) + 1
        at = 0
        for start, length, total in sorted(found):
            assert start == at and total == n
            at += length
        assert at == n


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, _ in pipeline.STAGES:
        out = dict(pipeline.STAGES)[name](spark, docs, "")
        assert out.count() == 0


def test_null_ids_and_further_columns(spark):
    text = "The plain words of this text stand here, one after another, and nothing is wrong. " * 2 + " ".join(f"word{k} is" for k in range(60)) + "."
    rows = [(None, text, "en", "s", 1, "x"), (None, text, "en", "s", 1, "x"), (7, text, "en", "s", 1, "x"), (8, text, "en", "s", 1, "x"), (8, text, "en", "s", 1, "x"), (9, "De tout autre chose, " + text[::-1], "fr", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, kept string").withColumn("component_id", F.lit(1))
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 7), (False, 9), (True, 0), (True, 0)]
    assert pipeline.judge_quality(spark, docs, "").columns == docs.columns
    assert language_id.UNKNOWN == "und"


def test_different_texts_under_one_id_are_judged_apart(spark):
    """Rows are dropped for their own text; one text of an id does not stand for another."""
    def text(seed):
        return " ".join(f"w{seed}x{k}" for k in range(80))

    a, b, c, d = (text(s) for s in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, d + " end"), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumn("text_hash", F.lit("x"))
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [x for x in got if x[0] < 5 and x[1] != d + " end"] == [(1, a), (2, b), (3, c), (3, d)]
    assert len([x for x in got if x[0] == 5]) == 1
