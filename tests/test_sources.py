"""Sources and sinks: archive scan, byte-range fetch, manifest, typed sink, materialize, crawl-index pruning."""

import gzip
import os
import tempfile

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusforge.operators import exchange as X
from corpusforge.plans import fixtures as fx
from corpusforge.sources import sinks
from corpusforge.sources import warc as W
from corpusforge.sources.crawl_index import read_crawl_index
from tests.conftest import SF_SMALL


def _exchange(uri, body, ms, date="2017-03-23T12:34:56Z"):
    return [
        {"type": "request", "headers": {"WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=request"},
         "block": b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"},
        {"type": "response", "headers": {"WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=response"},
         "block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body},
        {"type": "metadata", "headers": {"WARC-Target-URI": uri, "WARC-Date": date}, "block": f"fetchTimeMs: {ms}\r\n".encode()},
    ]


def test_archive_scan_assembly_and_fetch(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    ex1 = _exchange("http://a.com/", b"<html>hi</html>", 1500)
    ex2 = _exchange("http://b.com/", "<p >café</p>".encode(), 0)
    # an interleaved repeat: request of c twice before completion (overwrite mode keeps the second)
    ex3 = _exchange("http://c.com/", b"<b>x</b>", 7)
    recs = [{"type": "warcinfo", "headers": {}, "block": b"software: t\r\n"}] + ex1 + ex2 + [ex3[0]] + ex3
    spans = W.write_archive(os.path.join(d, "a.warc.gz"), recs)
    df = W.read_archives(spark, os.path.join(d, "*.warc.gz"))
    assert df.count() == len(recs) - 1  # warcinfo skipped
    out = {r["uri"]: r for r in X.html_exchange_dataset(df, on_unpaired="drop").collect()}
    assert out["http://a.com/"]["duration"] == 1.5 and out["http://b.com/"]["html"] == "<p >café</p>"
    assert out["http://c.com/"]["duration"] == 0.007
    rep = X.assemble_exchanges(df, on_unpaired="report").collect()
    assert rep == []  # the second request takes the place of the first: nothing is left open
    locs = spark.createDataFrame([("a.warc.gz", spans[2][0], spans[2][1])], "warc_filename string, warc_record_offset long, warc_record_length long")
    got = W.fetch_records(locs, d).collect()
    assert got[0]["rec_type"] == "response" and got[0]["target_uri"] == "http://a.com/"


def test_unpaired_error_mode(spark):
    recs = fx.archive_records(spark, SF_SMALL)
    import pytest

    with pytest.raises(Exception, match="unpaired"):
        X.assemble_exchanges(recs, on_unpaired="error").count()


def test_manifest_first(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "warc.paths.gz")
    with gzip.open(p, "wt") as f:
        f.write("crawl/a.warc.gz\ncrawl/b.warc.gz\ncrawl/c.warc.gz\n")
    rows = W.read_manifest(spark, p, first=2).collect()
    assert [r["path"] for r in rows] == ["crawl/a.warc.gz", "crawl/b.warc.gz"]


def test_typed_sink_row_groups(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.range(1500).select(F.col("id").cast("string").alias("sentence"), F.col("id").alias("label"), F.lit("h").alias("hostname"))
    path = os.path.join(d, "out")
    sinks.write_corpus(df.coalesce(1), path, sinks.CRAWL_SIZE_SCHEMA, rows_per_group=256, compression="gzip")
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    meta = pq.ParquetFile(os.path.join(path, files[0])).metadata
    assert meta.num_row_groups == 6 and meta.row_group(0).column(0).compression == "GZIP"
    assert str(pq.read_schema(os.path.join(path, files[0])).field("label").type) == "double"


def test_materialize_builds_once(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = os.path.join(d, "t")
    assert sinks.materialize(spark, path, build).count() == 3
    assert sinks.materialize(spark, path, build).count() == 3
    assert len(calls) == 1


def test_crawl_index_partition_and_column_pruning(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    root = os.path.join(d, "index")
    fx.crawl_index(spark, SF_SMALL).write.partitionBy("crawl", "subset").parquet(root)
    df = read_crawl_index(spark, root, fx.CRAWL, "warc")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crawl" in plan and "subset" in plan
    assert "ReadSchema: struct<url:string,url_host_name:string,warc_filename:string,warc_record_offset:bigint" in plan
    assert "page_id" not in plan
    assert df.count() == fx.crawl_index(spark, SF_SMALL).where("subset = 'warc'").count()


def test_crawl_size_from_archives(spark):
    from corpusforge.operators.crawl import crawl_size_from_archives

    d = tempfile.mkdtemp(dir="/tmp")
    bodies = [b"<html>root a</html>", b"%PDF-1.4 not html", b"<p >b root</p>"]
    recs = []
    for i, b in enumerate(bodies):
        recs.append({"type": "response", "headers": {"WARC-Target-URI": f"http://h{i}.com/", "Content-Type": "application/http; msgtype=response"},
                     "block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b})
    spans = W.write_archive(os.path.join(d, "x.warc.gz"), recs)
    rows = []
    for i, (off, ln) in enumerate(spans):
        rows.append((f"http://h{i}.com/", f"h{i}.com", "x.warc.gz", off, ln))
        rows.append((f"http://h{i}.com/page", f"h{i}.com", "x.warc.gz", 10_000 + i, 1))  # non-root rows are only counted
    index = spark.createDataFrame(rows, "url string, url_host_name string, warc_filename string, warc_record_offset long, warc_record_length long")
    got = {r["hostname"]: (r["sentence"], r["label"]) for r in crawl_size_from_archives(index, d).collect()}
    assert got == {"h0.com": ("<html>root a</html>", 2.0), "h2.com": ("<p >b root</p>", 2.0)}


def test_vocab_round_trip(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    voc = spark.createDataFrame([(0, "<unk>", 0.0, "UNKNOWN"), (1, "▁a", -1.5, "NORMAL")], "id int, piece string, score float, type string")
    sinks.write_vocab(voc, os.path.join(d, "v"))
    back = sinks.read_vocab(spark, os.path.join(d, "v")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(0, "<unk>", 0.0, "UNKNOWN"), (1, "▁a", -1.5, "NORMAL")]


def test_api_builds_once(spark):
    from corpusforge import api

    d = tempfile.mkdtemp(dir="/tmp")
    arch = os.path.join(d, "crawl")
    os.makedirs(arch)
    recs = _exchange("http://a.com/", b"<html>a</html>", 1500) + _exchange("http://b.com/", b"<p >b</p>", 0)
    W.write_archive(os.path.join(arch, "seg-0.warc.gz"), recs)
    W.write_archive(os.path.join(arch, "seg-1.warc.gz"), _exchange("http://c.com/", b"<b>c</b>", 7))
    manifest = os.path.join(d, "warc.paths.gz")
    with gzip.open(manifest, "wt") as f:
        f.write("seg-0.warc.gz\nseg-1.warc.gz\n")
    out = api.html_exchanges(spark, manifest, arch, os.path.join(d, "html"), first=1, compat=True)
    assert sorted(r["uri"] for r in out.collect()) == ["http://a.com/", "http://b.com/"]  # first file only
    files = [f for f in os.listdir(os.path.join(d, "html")) if f.endswith(".parquet")]
    assert pq.ParquetFile(os.path.join(d, "html", files[0])).metadata.row_group(0).column(0).compression == "GZIP"
    again = api.html_exchanges(spark, manifest, arch, os.path.join(d, "html"), first=2)
    assert again.count() == 2  # existing output is returned as it is
    # crawl-size from a partitioned index pointing at the same archive
    spans = W.write_archive(os.path.join(arch, "seg-2.warc.gz"), [recs[1]])
    idx = spark.createDataFrame(
        [("http://a.com/", "a.com", "seg-2.warc.gz", spans[0][0], spans[0][1], "CC-X", "warc"),
         ("http://a.com/x", "a.com", "seg-2.warc.gz", 999, 1, "CC-X", "warc")],
        "url string, url_host_name string, warc_filename string, warc_record_offset long, warc_record_length long, crawl string, subset string")
    idx.write.partitionBy("crawl", "subset").parquet(os.path.join(d, "index"))
    cs = api.crawl_size(spark, os.path.join(d, "index"), "CC-X", arch, os.path.join(d, "cs")).collect()
    assert [(r["hostname"], r["label"], r["sentence"]) for r in cs] == [("a.com", 2.0, "<html>a</html>")]


def test_write_blocks_partitioned(spark):
    from corpusforge.operators import batching as B

    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.createDataFrame([(0, 0, i, list(range(300))) for i in range(4)], "bucket int, batch int, rn int, input_ids array<int>")
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda _x: F.lit(1)))
    sinks.write_blocks(B.pack_blocks(df, [256, 512]), os.path.join(d, "blocks"))
    assert {"block_size=256", "block_size=512"} <= set(os.listdir(os.path.join(d, "blocks")))
    back = spark.read.parquet(os.path.join(d, "blocks")).where("block_size = 512")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(block_size" in back._jdf.queryExecution().executedPlan().toString()


def test_api_lm_blocks(spark):
    from corpusforge import api
    from corpusforge.plans.q_vocab import SPEC, learned_vocab

    d = tempfile.mkdtemp(dir="/tmp")
    pages = fx.table(spark, SF_SMALL, "pages")
    voc = learned_vocab(spark, SF_SMALL, SPEC, source="pages", text="html")
    out = api.lm_blocks(spark, pages, voc, SPEC, os.path.join(d, "blocks"), block_sizes=(256, 512), test_blocks=10)
    sizes = {r["block_size"]: r["n"] for r in out.groupBy("block_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(sizes) == {256, 512} and sizes[256] >= sizes[512] > 0
    assert out.where("split = 'test'").count() == 10
    assert out.where(F.size("input_ids") > F.col("block_size")).count() == 0


def test_api_classification_table(spark):
    from corpusforge import api
    from corpusforge.plans.q_batching import _labelled_src
    from corpusforge.plans.q_vocab import SPEC, learned_vocab

    d = tempfile.mkdtemp(dir="/tmp")
    out = api.classification_table(spark, _labelled_src(spark, SF_SMALL), "doc_id", "text", "label_name",
                                   learned_vocab(spark, SF_SMALL), SPEC, os.path.join(d, "cls"), max_length=32)
    rows = out.collect()
    assert len(rows) == _labelled_src(spark, SF_SMALL).count()
    assert {r["split"] for r in rows} == {"train", "validation", "test"}
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) <= 32 for r in rows)


def test_ranges_read_every_record_once(spark, tmp_path):
    """However a file is cut, each record comes once, with the same ordinal; several tasks read one file."""
    rng = np.random.default_rng(4)
    records = [{"type": ["request", "response", "metadata"][k % 3], "headers": {"WARC-Target-URI": f"http://h/{k}"}, "block": bytes(rng.integers(0, 256, 700, dtype=np.uint8)) + b"\x1f\x8b\x08 no member"} for k in range(300)]
    spans = W.write_archive(str(tmp_path / "a.warc.gz"), records)
    want = None
    for split in (0, 1, 333, 4096, 1 << 20):
        df = W.read_archives(spark, str(tmp_path / "*.warc.gz"), split_bytes=split) if split != 1 else W.read_archives(spark, str(tmp_path / "*.warc.gz"), split_bytes=901)
        rows = sorted((r.ordinal, r.offset, r.length, r.rec_type, r.target_uri, bytes(r.payload)) for r in df.collect())
        assert [(o, n) for _, o, n, *_ in rows] == spans
        assert want is None or rows == want
        want = rows
    cut = W.read_archives(spark, str(tmp_path / "*.warc.gz"), split_bytes=4096)
    assert cut.rdd.getNumPartitions() > 10
    assert cut.select(F.spark_partition_id().alias("p"), "ordinal").groupBy("p").count().count() > 10


def test_one_large_member_is_streamed(spark, tmp_path):
    """A file that is one gzip member with many records: a task holds a record at a time."""
    import gzip
    import tracemalloc

    path = tmp_path / "one.warc.gz"
    block = b"x" * 100_000
    with gzip.open(path, "wb", 1) as f:
        for k in range(600):
            f.write(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u{k}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    tracemalloc.start()
    n = sum(b.num_rows for b in W._scan(str(path), 0, None, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600 and peak < 40 << 20
    rows = W.read_archives(spark, str(path), types="*").select("ordinal", "target_uri", "length").orderBy("ordinal").collect()
    assert [r.target_uri for r in rows] == [f"u{k}" for k in range(600)]
    assert [r.length is None for r in rows] == [True] * 599 + [False] and rows[-1].length == path.stat().st_size


def test_written_archives_round_trip(spark, tmp_path):
    rows = [("a", 2, "response", "http://x/", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n", "é".encode()), ("a", 1, "request", "http://x/", None, "GET / HTTP/1.1\r\n", b""), ("b", 1, "metadata", "http://y/", None, None, b"fetchTimeMs: 5\r\n"), ("b", 2, "warcinfo", None, None, None, None)]
    df = spark.createDataFrame(rows, "file string, ordinal long, rec_type string, target_uri string, warc_date string, http_headers string, payload binary")
    out = str(tmp_path / "out")
    W.write_archives(df, out)
    assert [r.path for r in W.read_manifest(spark, f"{out}/manifest.gz").orderBy("ordinal").collect()] == ["a.warc.gz", "b.warc.gz"]
    got = W.read_archives(spark, f"{out}/*.warc.gz", types="*").orderBy("file", "ordinal").collect()
    want = sorted(rows)
    assert [(r.rec_type, r.target_uri, r.warc_date, r.http_headers, bytes(r.payload)) for r in got] == [(t, u, d, h, bytes(p or b"")) for _, _, t, u, d, h, p in want]
    places = spark.createDataFrame([("a.warc.gz", r.offset, r.length) for r in got[:2]], "warc_filename string, warc_record_offset long, warc_record_length long")
    assert sorted(r.rec_type for r in W.fetch_records(places, out).collect()) == ["request", "response"]
    assert not (tmp_path / "out" / "_parts").exists() or not list((tmp_path / "out" / "_parts").iterdir())


def test_limit_stops_early(spark):
    """Rows as without early stop, and little more is fetched than wanted."""
    from corpusforge.operators import crawl as C

    hosts = spark.createDataFrame([(f"h{k:04d}" if k else None, k) for k in range(2000)], "hostname string, n long")
    fetched = []

    def accept(some):
        fetched.append(some.count())
        return some.where(F.col("n") % 10 < 7)

    whole = [r.n for r in hosts.where(F.col("n") % 10 < 7).orderBy(F.col("hostname").asc_nulls_first()).collect()]
    for n in (1, 50, 700, 1400, 5000):
        fetched.clear()
        got = sorted(r.n for r in C.first_accepted(hosts, accept, n).collect())
        assert got == sorted(whole[:n])
        assert sum(fetched) <= max(1.5 * n / 0.7, 20) and sum(fetched) <= 2000
    assert C.first_accepted(hosts, accept, 0).count() == 0
