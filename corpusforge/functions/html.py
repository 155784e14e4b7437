"""URL and body predicates plus archive header fields, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions._util import as_col

# Fixed values from the WHATWG MIME sniffing standard ("rules for identifying
# an unknown MIME type", HTML patterns): header size, whitespace bytes skipped,
# the tag prefixes (case-insensitive) and the terminating bytes 0x20 / 0x3E.
SNIFF_HEADER_BYTES = 1445
SNIFF_HTML_TAGS = (
    "<!DOCTYPE HTML", "<HTML", "<HEAD", "<SCRIPT", "<IFRAME", "<H1", "<DIV", "<FONT",
    "<TABLE", "<A", "<STYLE", "<TITLE", "<B", "<BODY", "<BR", "<P", "<!--",
)
SNIFF_SPACE = "\\t\\n\\f\\r "
SNIFF_TERMINATORS = " >"

# Root page: scheme, authority, optional single slash, end of string.  Java's `$`
# also matches before a final newline, so `\z` is used on the Spark side.
ROOT_PAGE_JAVA = r"^https?://[^/]+/?\z"
ROOT_PAGE_RE2 = r"^https?://[^/]+/?$"


# the same pattern reads the same in Java regex (Spark) and RE2 (DuckDB)
SNIFF_JAVA = f"^[{SNIFF_SPACE}]*(?i:{'|'.join(SNIFF_HTML_TAGS)})[{SNIFF_TERMINATORS}]"
SNIFF_RE2 = SNIFF_JAVA


def is_root_page(url) -> Column:
    """URL names a site root (http or https, no path beyond one slash); null url is false."""
    u = as_col(url)
    return F.coalesce(u.rlike(ROOT_PAGE_JAVA), F.lit(False))


def sniff_head(body) -> Column:
    """The sniffing window as a string: bytes map 1:1 to chars through ISO-8859-1."""
    b = as_col(body)
    return F.decode(F.substring(b, 1, SNIFF_HEADER_BYTES), "ISO-8859-1")


def looks_like_html(body, is_binary: bool = True) -> Column:
    """WHATWG sniff says text/html.  For string bodies the first 1,445 chars are
    used: the pattern only matches ASCII, so chars and bytes agree on it."""
    head = sniff_head(body) if is_binary else F.substring(as_col(body), 1, SNIFF_HEADER_BYTES)
    return F.coalesce(head.rlike(SNIFF_JAVA), F.lit(False))


def parse_warc_date(s) -> Column:
    """``%Y-%m-%dT%H:%M:%SZ`` at second precision, as a naive UTC timestamp."""
    return F.to_timestamp_ntz(as_col(s), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def header_value(block, name: str) -> Column:
    """Value of the first ``name:`` line in a CRLF header block (case-insensitive); null when absent."""
    rx = f"(?im)^{name}:[ \\t]*([^\\r\\n]*)"
    b = as_col(block)
    return F.when(b.rlike(rx), F.regexp_extract(b, rx, 1))


def fetch_time_seconds(metadata_block) -> Column:
    """``fetchTimeMs`` header / 1000 as double; absent or empty gives null, non-numeric raises."""
    v = F.trim(header_value(metadata_block, "fetchTimeMs"))
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("double")).otherwise(v.cast("double") / 1000.0)


def content_type_charset(content_type) -> Column:
    """``charset`` parameter of a Content-Type value (quotes removed, case kept); null when absent."""
    rx = r"(?i);\s*charset\s*=\s*(\"([^\"]*)\"|'([^']*)'|([^;\s\"']+))"
    ct = as_col(content_type)
    q2 = F.regexp_extract(ct, rx, 2)
    q1 = F.regexp_extract(ct, rx, 3)
    bare = F.regexp_extract(ct, rx, 4)
    return F.when(ct.rlike(rx), F.when(q2 != "", q2).when(q1 != "", q1).otherwise(bare))
