"""Cases at the edges: null keys and labels, nothing or everything wanted, repeated keys, odd archives."""

import gzip
import os
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import batching as B
from corpusforge.operators import crawl as C
from corpusforge.operators import exchange as X
from corpusforge.operators import labels as L
from corpusforge.operators import split as S
from corpusforge.operators import vocab as V
from corpusforge.sources import warc as W
from tests.conftest import SF_SMALL

SPECS = ["", ",sd=t", ",sn=f", ",sn=f,sw=f", ",sn=f,ws=t", ",su=f", ",su=f,sn=f", ",su=f,sw=f", ",sw=f", ",sw=f,sd=t", ",sw=f,ws=t", ",sw=f,ws=t,sd=t", ",ws=t"]


def test_all_specs_cut_the_same_text(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    totals = set()
    for spec in SPECS:
        units = V.unit_counts(docs, V.VocabSpec.parse(f"cc-html1K{spec}"))
        row = units.agg(F.max(F.length("unit")).alias("longest"), F.sum(F.col("c") * F.length("unit")).alias("n")).first()
        assert row.longest > 0
        totals.add(row.n)
    assert len(totals) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9])
def test_limit_by_host_with_null_and_repeated_hosts(spark, n):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("b", 4), (None, 5)], "hostname string, v int")
    got = sorted(r.hostname or "" for r in C.limit_by_host(df, n).collect())
    assert got == ["", "", "a", "b", "b"][:n]


def test_host_tally_keeps_a_null_host(spark):
    index = spark.createDataFrame([("http://a.com/", "a.com", "f", 1, 1), ("http://a.com/x", "a.com", "f", 2, 1), ("http://x/", None, "f", 3, 1)], "url string, url_host_name string, warc_filename string, warc_record_offset long, warc_record_length long")
    got = {r.hostname: (r.n, r.n_root, r.url) for r in C.host_summary(index).collect()}
    assert got == {"a.com": (2, 1, "http://a.com/"), None: (1, 1, "http://x/")}


def test_labels_keep_rows_without_a_name_and_find_the_train_split(spark):
    rows = [(k, "t", None if k == 7 else f"n{k % 2}", f"s{k}" if k else "train") for k in range(30)]
    out, dictionary = L.labelled_dataset(spark.createDataFrame(rows, "k int, t string, name string, split string"), "k", "t", "name", split_col="split")
    got = {r.k: r.label for r in out.collect()}
    assert len(got) == 30 and got[7] is None and dictionary.count() == 2


def test_holdout_of_nothing_everything_and_repeated_keys(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    for n, want in ((0, 0), (5, 5), (50, 50), (80, 50)):
        assert S.holdout(df, "k", n).where("split = 'test'").count() == want
    with pytest.raises(ValueError, match="unique"):
        S.holdout(df.unionByName(df), "k", 5)


def test_batches_depend_on_the_rows_alone(spark):
    df = spark.range(2000).withColumnRenamed("id", "k").withColumn("input_ids", F.array_repeat(F.lit(1), 10)).withColumn("attention_mask", F.col("input_ids"))
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            blocks = B.pack_blocks(B.with_batches(df, "k"), 512)
            seen.add(blocks.agg(F.sum(F.size("input_ids"))).first()[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_lookups_lose_no_row(spark):
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "a"), (2, "b")], "id int, piece string")
    df = spark.createDataFrame([(1, ["a", "x", "b"], [1, 9]), (2, [], []), (3, None, None)], "k int, tokens array<string>, input_ids array<int>")
    assert {r.k: r.ids for r in V.pieces_to_ids(df, vocab, "k").collect()} == {1: [1, 0, 2], 2: [], 3: None}
    assert {r.k: r.pieces for r in V.ids_to_pieces(df, vocab, "k").collect()} == {1: ["a", None], 2: [], 3: None}
    text = spark.createDataFrame([(["▁", "▁a", "▁"],)], "p array<string>")
    assert text.select(V.detokenize(F.col("p"))).first()[0] == " a "
    assert text.select(V.detokenize(F.col("p"), whitespace_as_suffix=True)).first()[0] == "  a"


def record(kind, uri, block, **names):
    head = {"warc-type": kind, "WARC-TARGET-URI": uri, "warc-date": "2017-01-01T00:00:00Z", "content-length": str(len(block)), **{k.replace("_", "-"): v for k, v in names.items()}}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_archive_members_with_several_records_codings_and_any_header_case(spark):
    body = b"<html>" + b"x" * 50
    chunked = b"6\r\n<html>\r\n32\r\n" + b"x" * 50 + b"\r\n0\r\n\r\n"
    answers = [
        b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked,
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(body),
        b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(body),
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + body,
    ]
    folder = tempfile.mkdtemp(dir="/tmp")
    path = os.path.join(folder, "a.warc.gz")
    with open(path, "wb") as f:
        f.write(gzip.compress(b"".join(record("response", f"http://{k}/", a, Content_Type="application/http") for k, a in enumerate(answers))))
        f.write(gzip.compress(record("metadata", "http://9/", b"fetchTimeMs: 5\r\n\r\nfetchTimeMs: 7\xff")))
    for place in (path, f"file://{path}", f"{folder}/*.gz", folder):
        rows = W.read_archives(spark, place).orderBy("ordinal").collect()
        assert [r.target_uri for r in rows] == [f"http://{k}/" for k in (0, 1, 2, 3, 9)]
        assert all(bytes(r.payload) == body for r in rows[:4])
    with open(path, "ab") as f:
        f.write(gzip.compress(b"no record at all"))
    with pytest.raises(Exception, match="no WARC record"):
        W.read_archives(spark, path).count()


def test_metadata_with_broken_bytes_is_read_up_to_the_blank_line(spark):
    rows = [("f", k, t, "http://u/", "2017-01-01T00:00:00Z", None if t == "metadata" else "HTTP/1.1 200 OK\r\n", b) for k, (t, b) in enumerate([("request", b""), ("response", b"<html>x"), ("metadata", b"via: \xff\r\n\r\nfetchTimeMs: 7\r\n")])]
    df = spark.createDataFrame(rows, "file string, ordinal long, rec_type string, target_uri string, warc_date string, http_headers string, payload binary")
    out = X.html_exchange_dataset(df).collect()
    assert len(out) == 1 and out[0].duration is None
