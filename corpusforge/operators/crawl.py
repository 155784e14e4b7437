"""Crawl-size dataset: host tally over a crawl index, first root page per host,
record fetch by (file, offset), sniff, decode and filter.

Plan shape (late materialization): the index is counted on the host column
(partial + final hash aggregate, so a host holding a third of the rows is
pre-aggregated map-side), root rows alone are searched for the first, and only one location per host meets
the record bodies in an equi-join on (file, offset).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.charset import resolve_text
from corpusforge.functions.html import is_root_page, looks_like_html
from corpusforge.functions.text import has_interior_nul, strip_trailing_nul

INDEX_COLUMNS = ("url", "url_host_name", "warc_filename", "warc_record_offset", "warc_record_length")
LOCATION = ("url", "warc_filename", "warc_record_offset", "warc_record_length")


def root_pages(index: DataFrame) -> DataFrame:
    """Index rows whose URL is a site root (B1)."""
    return index.where(is_root_page(F.col("url")))


def host_summary(index: DataFrame, order_by: Sequence[str] = ("url", "warc_filename", "warc_record_offset")) -> DataFrame:
    """Per host: record count over all rows, root-page count, and the first root page by ``order_by``.

    The counts are a hash aggregate over the host column.  Only root rows, about one
    for each host, meet the aggregate that picks the first of them by a struct (which
    Spark sorts for), and its result joins the counts on the host.  A stream keeps both in
    the state of one aggregate.
    """
    order = list(order_by)
    root = is_root_page(F.col("url"))
    host = F.col("url_host_name").alias("hostname")
    counts = index.select(host, root.alias("root")).groupBy("hostname").agg(F.count(F.lit(1)).alias("n"), F.count_if("root").alias("n_root"))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], *[F.col(c) for c in LOCATION])
    first = index.select(*INDEX_COLUMNS).where(root).groupBy(host).agg(F.min(key).alias("first"))
    if index.isStreaming:
        both = index.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.count_if(root).alias("n_root"), F.min(F.when(root, key)).alias("first"))
        return both.select("hostname", "n", "n_root", *[F.col(f"first.{c}").alias(c) for c in LOCATION])
    joined = counts.alias("c").join(first.alias("f"), F.col("c.hostname").eqNullSafe(F.col("f.hostname")), "left")
    return joined.select("c.hostname", "n", "n_root", *[F.col(f"first.{c}").alias(c) for c in LOCATION])


def first_root_page(index: DataFrame, **kw) -> DataFrame:
    """Hosts having at least one root page (A3) with their first root location (A4)."""
    return host_summary(index, **kw).where(F.col("n_root") > 0)


def fetch_records(locations: DataFrame, records: DataFrame) -> DataFrame:
    """Equi-join one location per host onto the record table on (file, offset).

    Spark broadcasts the locations if their bytes stay under its threshold; else both sides shuffle.
    """
    return records.join(locations, ["warc_filename", "warc_record_offset"])


def crawl_size_dataset(index: DataFrame, records: DataFrame, limit: int | None = None, **kw) -> DataFrame:
    """(sentence, label, hostname): decoded root page of each host, label = record count."""
    hosts = first_root_page(index, **kw).select("hostname", "n", "warc_filename", "warc_record_offset")
    slim = records.select("warc_filename", "warc_record_offset", "http_headers", "payload")
    return first_accepted(hosts, lambda some: accepted(fetch_records(some, slim)), limit)


def crawl_size_from_archives(index: DataFrame, base: str, limit: int | None = None, **kw) -> DataFrame:
    """Crawl-size dataset reading only the first root page of each host by byte range.

    This is the late-materialization path for a real crawl: the index aggregate
    is narrow, and archive bytes are read for one record per host.
    """
    from corpusforge.sources.warc import fetch_records as fetch_ranges

    hosts = first_root_page(index, **kw).select("hostname", "n", "warc_filename", "warc_record_offset", "warc_record_length")
    return first_accepted(hosts, lambda some: accepted(fetch_ranges(some, base)), limit)


def first_accepted(hosts: DataFrame, accept: Callable[[DataFrame], DataFrame], n: int | None, key: str = "hostname") -> DataFrame:
    """The first ``n`` rows that ``accept`` makes of the hosts, in host order; all of them without ``n`` (L1).

    Hosts (one row each) are taken in ranges of their order until n rows are accepted: the first range
    has n hosts, and each further one as many as the acceptance so far lets expect, so little
    more is fetched than is wanted.  A range is found on the host column alone; null comes first.  What
    a range gives is checkpointed, so it is fetched once.
    """
    if n is None:
        return accept(hosts)
    if n <= 0:
        return accept(hosts.limit(0))
    hosts = hosts.checkpoint(eager=True)
    out, have, seen, rest = None, 0, 0, hosts
    while True:
        want = n - have if not seen else math.ceil((n - have) * 1.1 * seen / max(have, 1))
        found = rest.select(key).orderBy(F.col(key).asc_nulls_first()).limit(want).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last")).first()
        last = F.lit(found["last"])
        inside = F.col(key).isNull() if found["last"] is None else F.col(key).isNull() | (F.col(key) <= last)
        got = accept(rest.where(inside)).checkpoint(eager=True)
        count = got.count()
        if have + count >= n:
            got = limit_by_host(got, n - have, key, materialize=False)
        out = got if out is None else out.unionByName(got)
        have, seen = have + count, seen + found["n"]
        if have >= n or found["n"] < want:
            return out
        rest = rest.where(~inside)


def accepted(fetched: DataFrame) -> DataFrame:
    """Sniff, decode, strip and filter fetched (hostname, n, http_headers, payload) rows.

    The sniff is computed in the same projection as the decode (a non-deterministic
    Arrow UDF), which keeps Catalyst from pushing it below the join onto every
    record: it runs on the one fetched row per host.
    """
    ctype = F.regexp_extract(F.col("http_headers"), r"(?im)^content-type:[ \t]*([^\r\n]*)", 1)
    decoded = fetched.select(
        "hostname", "n", looks_like_html(F.col("payload")).alias("is_html"),
        resolve_text(F.col("payload"), ctype)["text"].alias("raw"),
    )
    return (
        decoded.where(F.col("is_html"))
        .select(strip_trailing_nul(F.col("raw")).alias("sentence"), F.col("n").cast("double").alias("label"), "hostname")
        .where(~F.contains(F.col("sentence"), F.lit("\u0000")))
    )


def limit_by_host(df: DataFrame, n: int, key: str = "hostname", materialize: bool = True) -> DataFrame:
    """First ``n`` rows in key order without moving bodies through one task (L1).

    The n-th key is found by a TakeOrdered over the key column only, then a plain
    filter keeps rows before it and, of the rows with that key, as many as are
    still wanted.  Null keys come first.  ``df`` is checkpointed to the reliable
    folder, so an expensive input is computed once; ``materialize=False`` leaves
    that out for a plain scan.
    """
    if n <= 0:
        return df.limit(0)
    if materialize:
        df = df.checkpoint(eager=True)
    keys = df.select(key).orderBy(F.col(key).asc_nulls_first()).limit(n)
    found = keys.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("t")).first()
    if found["n"] < n:
        return df
    last = F.lit(found["t"])
    before = F.lit(False) if found["t"] is None else F.col(key).isNull() | (F.col(key) < last)
    ahead = df.where(before)
    return ahead.unionByName(df.where(F.col(key).eqNullSafe(last)).limit(n - ahead.count()))


def nul_free(df: DataFrame, col: str = "text") -> DataFrame:
    """Strip trailing NULs, drop texts still holding one (T4 + B3)."""
    return df.withColumn(col, strip_trailing_nul(F.col(col))).where(~has_interior_nul(F.col(col)))
