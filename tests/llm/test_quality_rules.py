import re

import pytest

from corpusforge.llm.common import fresh
from corpusforge.llm.quality_rules import RULES, START, estimate, judge_quality, posterior

SCHEMA = "doc_id long, text string"


def brute(text):
    """The counts by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for k in range(len(words) - 2):
        where.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + d for ks in where.values() if len(ks) > 1 for k in ks for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a b c"),
    (5, "a b c a b c"),
    (6, "a a a a a"),
    (7, "x\ny\nx\nx\n\n \n \ny "),
    (8, "é#ü | <b> 💡 & 100%\r\n\x0b\x0c next\x85same word"),
    (9, "one two three four " * 40),
    (9, "one two three four " * 40),
    (None, "word " * 60),
    (10, "\n".join(f"w{k % 700} v{k % 350} u{k % 70}" for k in range(6000))),
]


def test_counts_match_brute_force(spark):
    rows = EDGE + [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out, name = judge_quality(spark, spark.createDataFrame(rows, SCHEMA))
    got = sorted(
        (tuple(r[c] for c in ("doc_id", *(name[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))) for r in out.collect()),
        key=str,
    )
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_keeps_clean_documents_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out, name = judge_quality(spark, docs)
    labels = labels.select("doc_id", labels["quality"].alias("label"))
    rows = out.join(labels, "doc_id").select("label", name["kept"], name["base_failed"]).collect()
    clean = [r for r in rows if r.label == 1 and not r[2]]
    junk = [r for r in rows if r.label == 0]
    assert sum(r[1] for r in clean) / len(clean) > 0.99
    assert sum(r[1] for r in junk) / len(junk) < 0.1


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 20, 7, "x", True)], "doc_id long, text string, n_words int, quality string, KEPT boolean")
    out, name = judge_quality(spark, docs)
    row = out.first()
    assert row["n_words"] == 7 and row["quality"] == "x" and row[name["n_words"]] == 80
    assert name["kept"] != "kept" and fresh(docs, "kept") == "kept_"
    out, name = judge_quality(spark, docs.limit(0))
    assert out.count() == 0


def test_estimation_finds_planted_accuracies(spark):
    """Votes drawn with known accuracies: the estimates come back near them."""
    import random

    from pyspark.sql import functions as F

    draw = random.Random(5)
    truth = {r: 0.65 + 0.03 * k for k, r in enumerate(RULES)}
    rows = {}
    for _ in range(30000):
        good = draw.random() < 0.7
        votes = tuple(0 if draw.random() < 0.3 else (1 if good else -1) * (1 if draw.random() < truth[r] else -1) for r in RULES)
        rows[votes] = rows.get(votes, 0) + 1
    patterns = spark.createDataFrame([(*v, n) for v, n in rows.items()], ", ".join(f"{r} int" for r in RULES) + ", n long")
    found = estimate(patterns)
    assert found.good == pytest.approx(0.7, abs=0.03)
    assert all(found.accuracy[r] == pytest.approx(truth[r], abs=0.03) for r in RULES)
    assert patterns.select(posterior(START, {r: F.lit(0) for r in RULES}).alias("p")).first().p == pytest.approx(0.8)


def test_carries_only_what_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 20, 7), (2, None, 8)], "doc_id long, text string, other int")
    out, name = judge_quality(spark, docs, carry=["doc_id"])
    assert "text" not in out.columns and "other" not in out.columns
    assert sorted((r.doc_id, r[name["n_words"]]) for r in out.collect()) == [(1, 80), (2, 0)]
