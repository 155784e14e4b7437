"""Crawl-index and fetch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.html import ROOT_PAGE_RE2, SNIFF_RE2, looks_like_html
from corpusforge.functions.text import has_interior_nul, has_reserved_mark, strip_trailing_nul
from corpusforge.operators import crawl
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register
from corpusforge.sources.crawl_index import select_crawl

_V = {"idx": fx.CRAWL_INDEX_SQL, "blocks": fx.ARCHIVE_BLOCKS_SQL}
_W = f"(SELECT * FROM idx WHERE crawl = '{fx.CRAWL}' AND subset = 'warc')"
_ROOT = f"regexp_matches(url, '{ROOT_PAGE_RE2}')"


def _index(spark, sf):
    return select_crawl(fx.crawl_index(spark, sf), fx.CRAWL, "warc")


_FIRST_SQL = f"""
first_root AS (
  SELECT url_host_name AS hostname, url, warc_filename, warc_record_offset, warc_record_length
  FROM (SELECT *, row_number() OVER (PARTITION BY url_host_name ORDER BY url, warc_filename, warc_record_offset) AS rn
        FROM {_W} w WHERE {_ROOT}) WHERE rn = 1),
tally AS (SELECT url_host_name AS hostname, CAST(count(*) AS BIGINT) AS n FROM {_W} w GROUP BY 1)
"""


def _with(extra: str, body: str) -> str:
    views = ",\n".join(f"{k} AS ({v.strip()})" for k, v in _V.items())
    return f"WITH {views},\n{extra.strip()}\n{body}"


@register("host_tally", "S1 A1 A2", _with(_FIRST_SQL, "SELECT hostname, n FROM tally"))
def host_tally(spark, sf):
    return crawl.host_summary(_index(spark, sf)).select("hostname", F.col("n").cast("bigint").alias("n"))


@register("root_pages", "B1", _with(_FIRST_SQL, f"SELECT page_id, url, url_host_name AS hostname FROM {_W} w WHERE {_ROOT}"))
def root_pages(spark, sf):
    return crawl.root_pages(_index(spark, sf)).select("page_id", "url", F.col("url_host_name").alias("hostname"))


@register(
    "first_root_page",
    "A3 A4",
    _with(_FIRST_SQL, "SELECT f.hostname, t.n, f.url, f.warc_filename, f.warc_record_offset, f.warc_record_length "
          "FROM first_root f JOIN tally t USING (hostname)"),
)
def first_root_page(spark, sf):
    return crawl.first_root_page(_index(spark, sf)).select(
        "hostname", F.col("n").cast("bigint").alias("n"), "url", "warc_filename", "warc_record_offset", "warc_record_length"
    )


@register(
    "index_lookup_join",
    "J3 S4",
    _with(_FIRST_SQL, "SELECT f.hostname, f.warc_filename, f.warc_record_offset, CAST(strlen(b.payload_text) AS BIGINT) AS n_bytes "
          "FROM first_root f JOIN blocks b USING (warc_filename, warc_record_offset)"),
)
def index_lookup_join(spark, sf):
    hosts = crawl.first_root_page(_index(spark, sf)).select("hostname", "warc_filename", "warc_record_offset")
    got = crawl.fetch_records(hosts, fx.archive_blocks(spark, sf))
    return got.select("hostname", "warc_filename", "warc_record_offset", F.octet_length("payload").cast("bigint").alias("n_bytes"))


CRAWL_SIZE_SQL = _with(
    _FIRST_SQL,
    f"""SELECT rtrim(b.payload_text, chr(0)) AS sentence, CAST(t.n AS DOUBLE) AS label, f.hostname
FROM first_root f JOIN tally t USING (hostname) JOIN blocks b USING (warc_filename, warc_record_offset)
WHERE regexp_matches(substr(b.payload_text, 1, 1445), '{SNIFF_RE2}') AND NOT contains(rtrim(b.payload_text, chr(0)), chr(0))""",
)


@register("crawl_size", "A5 C1 S1 A1 B1 A3 A4 J3 B2 T1 T4 B3", CRAWL_SIZE_SQL)
def crawl_size(spark, sf):
    return crawl.crawl_size_dataset(_index(spark, sf), fx.archive_blocks(spark, sf))


@register(
    "limit_by_host",
    "L1",
    _with(_FIRST_SQL, f"""SELECT * FROM (
SELECT rtrim(b.payload_text, chr(0)) AS sentence, CAST(t.n AS DOUBLE) AS label, f.hostname
FROM first_root f JOIN tally t USING (hostname) JOIN blocks b USING (warc_filename, warc_record_offset)
WHERE regexp_matches(substr(b.payload_text, 1, 1445), '{SNIFF_RE2}') AND NOT contains(rtrim(b.payload_text, chr(0)), chr(0))
ORDER BY hostname LIMIT 20)"""),
)
def limit_by_host(spark, sf):
    return crawl.crawl_size_dataset(_index(spark, sf), fx.archive_blocks(spark, sf), limit=20)


@register(
    "html_sniff",
    "B2",
    fx.sql_with({"bodies": fx.SNIFF_BODIES_SQL},
                f"SELECT id, kind, coalesce(regexp_matches(substr(body, 1, 1445), '{SNIFF_RE2}'), false) AS is_html FROM bodies"),
)
def html_sniff(spark, sf):
    b = fx.sniff_bodies(spark, sf)
    return b.select("id", "kind", looks_like_html(F.col("body"), is_binary=False).alias("is_html"))


@register(
    "nul_filter",
    "T4 B3",
    fx.sql_with({"docs": fx.MARKED_DOCUMENTS_SQL},
                "SELECT doc_id, rtrim(text, chr(0)) AS text FROM docs WHERE NOT contains(rtrim(text, chr(0)), chr(0))"),
)
def nul_filter(spark, sf):
    d = fx.marked_documents(spark, sf)
    return d.where(~has_interior_nul(F.col("text"))).select("doc_id", strip_trailing_nul(F.col("text")).alias("text"))


@register(
    "reserved_char_filter",
    "B5 B6",
    fx.sql_with({"docs": fx.MARKED_DOCUMENTS_SQL},
                "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM docs WHERE NOT contains(text, chr(9605))"),
)
def reserved_char_filter(spark, sf):
    d = fx.marked_documents(spark, sf)
    return d.where(~has_reserved_mark(F.col("text"))).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
