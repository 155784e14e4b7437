"""Work and memory that must not grow with the rows of a batch, of a bucket or of a frequent key."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.unigram import Lattice
from corpusforge.operators import batching as B
from corpusforge.operators import unigram_encoder as E
from corpusforge.operators import vocab as V
from corpusforge.plans.catalog import all_queries
from tests.conftest import SF_SMALL


def plain(lattice, rows):
    out = []
    for units in rows:
        tokens, ids = [], []
        for u in units or []:
            for piece, k in zip(*lattice.encode_word(u), strict=True):
                if k == 0 and ids and ids[-1] == 0:
                    tokens[-1] += piece
                else:
                    tokens.append(piece)
                    ids.append(k)
        out.append({"tokens": tokens, "ids": ids})
    return out


@pytest.mark.parametrize("limits", [(1 << 17, 1 << 16), (7, 40)])
def test_batches_are_segmented_as_unit_by_unit(monkeypatch, limits):
    """Whole scores, so many paths are equally good; unknown characters; null rows; pieces that are too long."""
    monkeypatch.setattr(E, "SLICE_UNITS", limits[0])
    monkeypatch.setattr(E, "LATTICE_CHARS", limits[1])
    monkeypatch.setattr(E, "BATCH_UNITS", 3 * limits[0])
    draw = random.Random(5)
    for size in [0, 3, 30] * 8:
        names = sorted({"".join(draw.choice("abc▁\U0001f600") for _ in range(draw.randint(1, 5))) for _ in range(size)})
        pieces = {p: (k + 1, float(-draw.randint(1, 4))) for k, p in enumerate(names)}
        rows = [None if draw.random() < 0.1 else ["".join(draw.choice("abcdx▁\U0001f600") for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(0, 6))] for _ in range(20)]
        given = pa.array(rows, pa.list_(pa.string()))
        got = [r for part in E.Encoder(pieces, 4).encoded([given[:5], given[5:5], given[5:]]) for r in part.to_pylist()]
        assert got == plain(Lattice(pieces, max_len=4), rows)


def test_a_worker_keeps_no_units():
    """Units of a batch are gone with it, and a batch comes out in parts."""
    encoder = E.Encoder({c: (k + 1, -1.0) for k, c in enumerate("0123456789u")}, 64)
    before = {k: v if isinstance(v, int) else len(v) for k, v in vars(encoder).items() if k != "trie"}
    batches = [pa.array([[f"u{n}" for n in range(b, b + 300)] for b in range(at, at + 300_000, 300)]) for at in (0, 300_000)]
    parts = [len(p) for p in encoder.encoded(batches)]
    assert sum(parts) == 2000 and max(parts) * 300 <= E.SLICE_UNITS
    assert before == {k: v if isinstance(v, int) else len(v) for k, v in vars(encoder).items() if k != "trie"}


def test_tokens_meet_the_planted_vocabulary_without_being_dealt_by_id(spark):
    plan = all_queries()["tokenize_planted"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("buckets", [3, None])
def test_rows_are_numbered_leaf_by_leaf(spark, buckets):
    """Ranks of whole buckets from small ranges of hashes, with keys that repeat and keys that are null."""
    keys = [*range(700), *range(0, 700, 70), *[None] * 5]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = B.with_batches(df, "k", batch_size=16, buckets=buckets, bucket_rows=50)
    assert got.columns == ["k", "h", "bucket", "rn", "batch"]
    if buckets:
        assert "_leaf" in got._jdf.queryExecution().executedPlan().toString().split("Window")[1]
    found = {}
    for r in got.collect():
        assert r.batch == (r.rn - 1) // 16 and (r.h is None or not buckets or r.bucket == r.h % buckets)
        found.setdefault(r.bucket, []).append((r.rn, r.h, r.k))
    assert sum(map(len, found.values())) == len(keys) and any(k is None for _, _, k in found[None if buckets else 1])
    for rows in found.values():
        assert [n for n, _, _ in sorted(rows, key=lambda r: r[0])] == list(range(1, len(rows) + 1))
        assert sorted(rows, key=lambda r: r[0]) == sorted(rows, key=lambda r: (r[1] or 0, r[2] or 0, r[0]))


def test_lookups_keep_elements_in_columns(spark):
    """Null and empty arrays, null and unknown elements, in both directions; repeated keys."""
    voc = spark.createDataFrame([(5, "a"), (6, "b"), (7, "é")], "id int, piece string")
    df = spark.createDataFrame([(1, ["a", "x", None, "é"], [5, 9, None, 7]), (2, [], []), (3, None, None), (3, ["b"], [6]), (None, ["b", "b"], [6, 6])], "k int, t array<string>, i array<int>")
    ids = sorted((str(r.k), r.ids or []) for r in V.pieces_to_ids(df, voc, "k", "t").collect())
    assert ids == [("1", [5, 0, 0, 7]), ("2", []), ("3", []), ("3", [6]), ("None", [6, 6])]
    rows = V.ids_to_pieces(df, voc, "k", "i").collect()
    assert sorted((str(r.k), str(r.pieces)) for r in rows) == [("1", "['a', None, None, 'é']"), ("2", "[]"), ("3", "None"), ("3", "['b']"), ("None", "['b', 'b']")]


def test_triage_sums_up_tokens_where_they_are_made(spark):
    """No row for each token: the tallies of a task are those of the tokens themselves, joined unknown characters included."""
    voc = spark.createDataFrame([(0, "<unk>", 0.0, "UNKNOWN"), *((k + 1, p, -1.0 - k, "NORMAL") for k, p in enumerate(["▁", "a", "b", "ab", "▁a"]))], V.VOCAB_SCHEMA)
    docs = spark.createDataFrame([("ab xyz ab",), ("xx  yy a",), (None,), ("",), ("a b ab",)], "text string")
    got = V.vocab_triage(docs, {"cc-html1K": voc})
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [r for d in V.tokenize(docs, voc, "cc-html1K").collect() for r in zip(d.tokens, d.input_ids, strict=True)]
    bits = sum(15.0 * len(t) if k == 0 else k for t, k in rows) / math.log(2)
    chars = sum(len(r.text or "") for r in docs.collect())
    found = got.first()
    assert found.tokens_per_char == pytest.approx(len(rows) / chars) and found.bits_per_char == pytest.approx(bits / chars)


def test_packing_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """However few buckets and shuffle partitions there are, more rows make more tasks, not larger ones."""
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    df = spark.range(6000).select(F.col("id").alias("k"), F.array_repeat(F.lit(7), 3).alias("input_ids"))
    got = B.with_batches(df, "k", batch_size=10, buckets=2)
    numbered = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    blocks = B.pack_blocks(got, [5, 6], cols=["input_ids"])
    packed = blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.size("input_ids")).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert numbered <= 600 and packed[0] <= 600 * 3 * 2
    assert 2 * 6000 * 3 - 2 * 2 * 30 < packed[1] <= 2 * 6000 * 3  # batches of 30 tokens: a tail in the last of a bucket only
    assert got.agg(F.countDistinct("bucket", "rn")).first()[0] == 6000


def test_python_workers_get_batches_of_bounded_bytes(spark):
    """A batch has a few megabytes, however many and long the rows of a task are."""
    from corpusforge.session import BATCH_BYTES, prepare

    prepare(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("abcde "), 500).alias("t"))
    got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 9000 * 3000 and max(got) < 2 * BATCH_BYTES


def test_a_text_to_rewrite_costs_its_rewritten_characters(monkeypatch):
    """Characters that stay cost no lookup in the tables."""
    from corpusforge.functions import normalizer as N

    asked = []

    class Counting(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    one, other, *rest = N._rules()
    monkeypatch.setattr(N, "_rules", lambda: (Counting(one), Counting(other), *rest))
    assert N.normalized("ab\u00e9 zo\u00eft " * 1000 + "\uff21 \ufb01") == "ab\u00e9 zo\u00eft " * 1000 + "A fi"
    assert len(asked) == 2


def test_tallies_merge_as_they_grow(monkeypatch):
    """Sums by id are the same however often the parts are merged, and a merge waits for as many rows as there are sums."""
    pieces = {chr(0x4E00 + k): (k + 1, -1.0) for k in range(300)}
    encoder = E.Encoder(pieces, 4)
    rows = [[chr(0x4E00 + (k * 7 + j) % 310) for j in range(20)] for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["units"])
    whole = next(encoder.tallied([batch]))
    merges, merged = [], E._merged
    monkeypatch.setattr(E, "_merged", lambda parts: merges.append(len(parts)) or merged(parts))
    monkeypatch.setattr(E, "SLICE_UNITS", 100)
    monkeypatch.setattr(E, "MERGE_ROWS", 50)
    assert next(encoder.tallied([batch])).equals(whole)
    assert sum(whole.column(1).to_pylist()) <= 8000 and sum(whole.column(2).to_pylist()) == 8000
    assert 2 <= len(merges) < 50  # 80 parts
