"""Archive queries (S2 S3 S4 K1 L2 J3 C1 by byte range) over web archives written from ``pages``."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.operators import crawl
from corpusforge.operators import exchange as X
from corpusforge.plans import fixtures as fx
from corpusforge.plans.q_crawl import CRAWL_SIZE_SQL
from corpusforge.plans.q_exchange import _GROUPS, _PROJECTION_BODY
from corpusforge.plans.registry import register
from corpusforge.session import ensure_checkpoint_dir
from corpusforge.sources import sinks, warc
from corpusforge.sources.crawl_index import select_crawl

#: Small ranges, so that the archives of small tables are cut as well.
SPLIT = 1 << 18


def _folder(spark, sf: str, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{hashlib.md5(sf.encode()).hexdigest()[:16]}"


def archives(spark, sf: str) -> str:
    """Folder with the F-REC records of ``pages`` as archives, written once; the record id keeps the ordinal."""
    path = _folder(spark, sf, "archives")
    if not sinks._fs_exists(spark, f"{path}/manifest.gz"):
        record_id = F.create_map(F.lit("WARC-Record-ID"), F.concat(F.lit("<urn:ordinal:"), F.col("ordinal").cast("string"), F.lit(">")))
        warc.write_archives(fx.archive_records(spark, sf).withColumn("warc_headers", record_id), path)
    return path


def scanned(spark, sf: str, types: str = ",".join(warc.WANTED)):
    """Records of the archives of the manifest, with the ordinal they were written from."""
    base = archives(spark, sf)
    paths = [f"{base}/{r['path']}" for r in warc.read_manifest(spark, f"{base}/manifest.gz").orderBy("ordinal").collect()]
    rows = warc.read_archive_list(spark, paths, types, split_bytes=SPLIT)
    given = F.regexp_extract(F.col("warc_headers")["WARC-Record-ID"], r"ordinal:(\d+)", 1).cast("long")
    return rows.withColumn("given", given).withColumn("archive", F.regexp_extract("file", r"([^/]+)\.warc\.gz$", 1))


@register(
    "archive_scan",
    "S2 S3 K1 (archives) B4",
    f"""WITH rec AS ({fx.ARCHIVE_RECORDS_SQL.strip()})
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY ordinal) AS BIGINT) AS place, ordinal, rec_type, target_uri, warc_date, http_headers, md5(payload_text) AS payload_md5
FROM rec WHERE rec_type IN ('request', 'response', 'metadata')""",
)
def q_archive_scan(spark, sf):
    rows = scanned(spark, sf)
    place = F.row_number().over(Window.partitionBy("archive").orderBy("ordinal")).cast("long")
    return rows.select(F.col("archive").alias("file"), place.alias("place"), F.col("given").alias("ordinal"), "rec_type", "target_uri", "warc_date", "http_headers", F.md5("payload").alias("payload_md5"))


@register(
    "archive_manifest",
    "S2 L2",
    f"""WITH rec AS ({fx.ARCHIVE_RECORDS_SQL.strip()})
SELECT CAST(row_number() OVER (ORDER BY file) - 1 AS BIGINT) AS ordinal, file || '.warc.gz' AS path FROM (SELECT DISTINCT file FROM rec) ORDER BY file LIMIT 3""",
)
def q_archive_manifest(spark, sf):
    return warc.read_manifest(spark, f"{archives(spark, sf)}/manifest.gz", first=3)


@register(
    "archive_fetch",
    "S4 by byte range",
    f"""WITH rec AS ({fx.ARCHIVE_RECORDS_SQL.strip()})
SELECT file AS warc_filename, ordinal, rec_type, target_uri, http_headers, md5(payload_text) AS payload_md5 FROM rec WHERE rec_type = 'response'""",
)
def q_archive_fetch(spark, sf):
    places = scanned(spark, sf, "response").select(
        F.concat("archive", F.lit(".warc.gz")).alias("warc_filename"), F.col("offset").alias("warc_record_offset"), F.col("length").alias("warc_record_length"), F.col("given").alias("ordinal")
    )
    got = warc.fetch_records(places, archives(spark, sf))
    return got.select(F.regexp_replace("warc_filename", r"\.warc\.gz$", "").alias("warc_filename"), "ordinal", "rec_type", "target_uri", "http_headers", F.md5("payload").alias("payload_md5"))


@register("crawl_size_archives", "C1 A5 S4 L1", CRAWL_SIZE_SQL)
def q_crawl_size_archives(spark, sf):
    """The crawl-size table with one record per host read by byte range; the index has the archives' own offsets."""
    page = (F.col("given") / 10).cast("long")
    places = scanned(spark, sf, "response").where("given < 100000000").select(
        page.alias("page_id"), F.concat("archive", F.lit(".warc.gz")).alias("warc_filename"), F.col("offset").alias("warc_record_offset"), F.col("length").alias("warc_record_length")
    )
    index = select_crawl(fx.crawl_index(spark, sf), fx.CRAWL, "warc").drop("warc_filename", "warc_record_offset", "warc_record_length").join(places, "page_id")
    return crawl.crawl_size_from_archives(index, archives(spark, sf))


@register("corpus_sink", "K1 C2", _GROUPS + _PROJECTION_BODY)
def q_corpus_sink(spark, sf):
    """The HTML exchange table through the typed sink, in the reference's file layout, read again."""
    path = _folder(spark, sf, "corpus")
    rows = X.html_exchange_dataset(fx.archive_records(spark, sf), on_unpaired="drop")
    sinks.write_corpus(rows, path, sinks.HTML_EXCHANGE_SCHEMA, rows_per_group=sinks.COMPAT_ROWS_PER_GROUP, compression=sinks.COMPAT_CODEC, mode="overwrite")
    return spark.read.parquet(path)
