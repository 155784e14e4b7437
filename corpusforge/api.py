"""User-facing builds, one per reference entry point.  Each is build-once: an
existing complete output is returned as it is (K2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusforge.operators.batching import pack_blocks, truncate_pad, with_batches
from corpusforge.operators.labels import labelled_dataset
from corpusforge.operators.crawl import crawl_size_from_archives
from corpusforge.operators.split import holdout
from corpusforge.operators.exchange import html_exchange_dataset
from corpusforge.operators.vocab import learn_vocab, tokenize
from corpusforge.sources import sinks
from corpusforge.sources.crawl_index import read_crawl_index
from corpusforge.sources.warc import read_archive_list, read_manifest

# Fixed values from the reference builds, for callers that want its tables: the row count of the
# crawl-size table and the number of archive files taken from the manifest; and the LM blocks held out.
CRAWL_SIZE_ROWS = 180_000
HTML_FIRST_FILES = 1
LM_TEST_BLOCKS = 4096


def crawl_size(spark: SparkSession, index_root: str, crawl: str, archives_base: str, dst: str,
               limit: int | None = None, compat: bool = False) -> DataFrame:
    """(sentence, label, hostname) for hosts with a root page, written to ``dst``."""

    def build() -> DataFrame:
        index = read_crawl_index(spark, index_root, crawl, "warc")
        return crawl_size_from_archives(index, archives_base, limit=limit)

    return _build_once(spark, dst, build, sinks.CRAWL_SIZE_SCHEMA, compat)


def html_exchanges(spark: SparkSession, manifest: str, archives_base: str, dst: str,
                   first: int | None = None, on_unpaired: str = "error", compat: bool = False) -> DataFrame:
    """(html, uri, req, res, when, duration) from the archives of a manifest, or its first ``first``."""

    def build() -> DataFrame:
        paths = [os.path.join(archives_base, r["path"]) for r in read_manifest(spark, manifest, first).collect()]
        return html_exchange_dataset(read_archive_list(spark, paths), on_unpaired=on_unpaired, in_order=True)  # whole files

    return _build_once(spark, dst, build, sinks.HTML_EXCHANGE_SCHEMA, compat)


def vocabulary(spark: SparkSession, name: str, corpus: DataFrame, root: str, text: str = "html") -> DataFrame:
    """The vocabulary called ``name`` (``cc-html<N>K[,switches]``), learned once from ``corpus`` and kept under ``root``."""
    path = f"{root.rstrip('/')}/{name}"
    return sinks.materialize(spark, path, lambda: learn_vocab(corpus, name, text))


def lm_blocks(spark: SparkSession, pages: DataFrame, vocab: DataFrame, spec: str, dst: str,
              block_sizes=(512,), key: str = "page_id", text: str = "html", test_blocks: int = LM_TEST_BLOCKS) -> DataFrame:
    """Pre-training blocks (C3): tokenize, batch, pack into each block size, hold out
    ``test_blocks`` blocks; written once, one folder per block size."""
    if not sinks._fs_exists(spark, f"{dst.rstrip('/')}/_SUCCESS"):
        tok = tokenize(pages.select(key, text), vocab, spec, text=text).drop(text, "tokens")
        blocks = pack_blocks(with_batches(tok, key), list(block_sizes))
        keyed = blocks.withColumn("block_key", F.concat_ws(":", "block_size", "bucket", "batch", "block"))
        sinks.write_blocks(holdout(keyed, "block_key", test_blocks, materialize=True), dst, mode="overwrite")
    return spark.read.parquet(dst)


def classification_table(spark: SparkSession, df: DataFrame, key: str, text: str, label_name: str,
                         vocab: DataFrame, spec: str, dst: str, max_length: int = 512, pad_to: str = "batch",
                         pad_id: int = 3) -> DataFrame:
    """Fine-tuning table (C4): labels encoded through a dictionary, auto split when no
    validation split is given, tokens cut to ``max_length`` and padded; written once."""
    if not sinks._fs_exists(spark, f"{dst.rstrip('/')}/_SUCCESS"):
        data, _dictionary = labelled_dataset(df, key, text, label_name)
        tok = tokenize(data, vocab, spec, text="sentence", max_length=max_length).drop("sentence", "tokens", "attention_mask")
        padded = truncate_pad(with_batches(tok, key), max_length, pad_to=pad_to, pad_id=pad_id)
        padded.select(key, "label", "label_name", "split", "input_ids", "attention_mask").write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def _build_once(spark, dst, build, schema, compat):
    if sinks._fs_exists(spark, f"{dst.rstrip('/')}/_SUCCESS"):
        return spark.read.parquet(dst)
    opts = {"rows_per_group": sinks.COMPAT_ROWS_PER_GROUP, "compression": sinks.COMPAT_CODEC} if compat else {}
    sinks.write_corpus(build(), dst, schema, mode="overwrite", **opts)
    return spark.read.parquet(dst)
