"""Charset detection, decode scoring and the detector study."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.charset import decode_score, detect_charsets, resolve_text
from corpusforge.operators.charset_study import charset_study
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register

_P = f"WITH p AS ({fx.CHARSET_PAGES_SQL.strip()})"
_PRESCAN = r"(?i)<meta[\s/][^>]*?charset\s*=\s*[\"']?\s*([^\s\"';>/]+)"
_PRESCAN_SQL = _PRESCAN.replace("'", "''")
_HEAD = "regexp_replace(substr(html, 1, 1024), '<!--(?s:.*?)-->', '', 'g')"


def _pages(spark, sf):
    return fx.charset_pages(spark, sf)


@register(
    "charset_detect",
    "T2 B10",
    _P + f""",
d AS (SELECT page_id, lower(regexp_extract({_HEAD}, '{_PRESCAN_SQL}', 1)) AS prescan, ctype_codec FROM p)
SELECT page_id, prescan AS prescan_label,
  array_to_string(list_distinct_ordered, ',') AS candidates
FROM (SELECT page_id, prescan,
        CASE WHEN ctype_codec IS NULL OR ctype_codec = 'utf-8' THEN ['utf-8'] ELSE ['utf-8', ctype_codec] END AS list_distinct_ordered
      FROM d)""",
)
def q_charset_detect(spark, sf):
    p = _pages(spark, sf)
    c = detect_charsets(F.col("body"), F.col("content_type"))
    names = F.array_distinct(F.transform(c, lambda x: F.coalesce(x["codec"], x["label"])))
    prescan = F.filter(c, lambda x: x["rank"] == 1)
    return p.select(
        "page_id", F.lower(F.try_element_at(prescan, F.lit(1))["label"]).alias("prescan_label"), F.array_join(names, ",").alias("candidates")
    )


_RESOLVED = _P + """,
r AS (SELECT page_id,
  CASE WHEN ctype_known_other AND strlen(html) > length(html) THEN 'iso8859-1' ELSE 'utf-8' END AS charset,
  CASE WHEN ctype_known_other AND strlen(html) > length(html) THEN strlen(html) ELSE length(html) END AS n_chars
FROM p)
"""


@register("charset_resolve", "T1 T3 T4", _RESOLVED + "SELECT page_id, charset, CAST(n_chars AS INTEGER) AS n_chars, CAST(-n_chars AS DOUBLE) AS score FROM r")
def q_charset_resolve(spark, sf):
    p = _pages(spark, sf)
    # the struct is bound once, so the decode runs once for each row
    r = p.select("page_id", resolve_text(F.col("body"), F.col("content_type")).alias("r"))
    return r.select("page_id", "r.charset", F.length("r.text").alias("n_chars"), "r.score")


@register(
    "charset_score",
    "T3",
    """SELECT doc_id, round(length(t) * (1 - 2.0 / (1 + (length(t) - length(replace(t, chr(65533), ''))))), 6) AS score
FROM (SELECT doc_id, text || repeat(chr(65533), CAST(doc_id % 3 AS INTEGER)) AS t FROM documents)""",
)
def q_charset_score(spark, sf):
    d = fx.table(spark, sf, "documents")
    t = F.concat(F.col("text"), F.repeat(F.lit("�"), (F.col("doc_id") % 3).cast("int")))
    return d.select("doc_id", F.round(decode_score(t), 6).alias("score"))


@register(
    "charset_study",
    "A16",
    _RESOLVED + """SELECT charset, CASE WHEN charset = 'utf-8' THEN 'bom' ELSE 'content-type' END AS detector,
  CASE page_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'ISO-8859-1' WHEN 2 THEN 'x-unknown-label' END AS declared,
  CAST(count(*) AS BIGINT) AS n, round(avg(-n_chars), 6) AS avg_score, round(avg(strlen(html)), 6) AS avg_bytes
FROM r JOIN p USING (page_id) GROUP BY ALL""",
)
def q_charset_study(spark, sf):
    p = _pages(spark, sf)
    study = charset_study(p)
    return study.withColumns({"avg_score": F.round("avg_score", 6), "avg_bytes": F.round("avg_bytes", 6)})
