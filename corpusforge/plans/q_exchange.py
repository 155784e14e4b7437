"""Exchange assembly and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.html import SNIFF_RE2
from corpusforge.operators import exchange as X
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register

# The pairing rule record by record: st is what is open after each record of a (file, URI).
_GROUPS = f"""
WITH RECURSIVE rec AS ({fx.ARCHIVE_RECORDS_SQL.strip()}),
w AS (SELECT *, row_number() OVER (PARTITION BY file, target_uri ORDER BY ordinal) AS r,
        count(*) OVER (PARTITION BY file, target_uri) AS last_r
      FROM rec WHERE rec_type IN ('request', 'response', 'metadata')),
st AS (
  SELECT file, target_uri, r, last_r, 1 AS generation,
    CASE WHEN rec_type = 'request' THEN ordinal END AS q,
    CASE WHEN rec_type = 'response' THEN ordinal END AS s,
    CASE WHEN rec_type = 'metadata' THEN ordinal END AS m
  FROM w WHERE r = 1
  UNION ALL
  SELECT w.file, w.target_uri, w.r, w.last_r,
    st.generation + CASE WHEN q IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL THEN 1 ELSE 0 END,
    CASE WHEN rec_type = 'request' THEN ordinal WHEN q IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL THEN NULL ELSE q END,
    CASE WHEN rec_type = 'response' THEN ordinal WHEN q IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL THEN NULL ELSE s END,
    CASE WHEN rec_type = 'metadata' THEN ordinal WHEN q IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL THEN NULL ELSE m END
  FROM st JOIN w ON w.file = st.file AND w.target_uri = st.target_uri AND w.r = st.r + 1),
g AS (SELECT * FROM st WHERE r = last_r OR (q IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL)),
x AS (SELECT g.file, g.target_uri AS uri, CAST(generation AS INTEGER) AS generation,
        CAST((q IS NOT NULL)::INT + (s IS NOT NULL)::INT + (m IS NOT NULL)::INT AS BIGINT) AS n_records,
        q AS req_ordinal, s AS res_ordinal, m AS meta_ordinal,
        a.http_headers AS req_headers, a.payload_text AS req_body, a.warc_date AS req_date,
        b.http_headers AS res_headers, b.payload_text AS res_body, c.payload_text AS meta_body
      FROM g LEFT JOIN w a ON a.file = g.file AND a.ordinal = q LEFT JOIN w b ON b.file = g.file AND b.ordinal = s
        LEFT JOIN w c ON c.file = g.file AND c.ordinal = m)
"""
_COMPLETE = "req_ordinal IS NOT NULL AND res_ordinal IS NOT NULL AND meta_ordinal IS NOT NULL"


def _records(spark, sf):
    return fx.archive_records(spark, sf)


@register(
    "exchange_assembly",
    "J1 E6 B4",
    _GROUPS + f"SELECT file, uri, generation, req_ordinal, res_ordinal, meta_ordinal FROM x WHERE {_COMPLETE}",
)
def q_exchange_assembly(spark, sf):
    pairs = X.pair_records(_records(spark, sf)).where("request is not null and response is not null and metadata is not null")
    return pairs.select(
        "file", "uri", "generation", F.col("request").alias("req_ordinal"), F.col("response").alias("res_ordinal"), F.col("metadata").alias("meta_ordinal")
    )


@register(
    "exchange_unpaired",
    "J2",
    _GROUPS + """SELECT file, uri, generation, n_records,
  array_to_string(list_filter([CASE WHEN req_ordinal IS NULL THEN 'request' END,
    CASE WHEN res_ordinal IS NULL THEN 'response' END, CASE WHEN meta_ordinal IS NULL THEN 'metadata' END],
    lambda v: v IS NOT NULL), ',') AS missing
FROM x WHERE NOT (""" + _COMPLETE + ")",
)
def q_exchange_unpaired(spark, sf):
    rep = X.assemble_exchanges(_records(spark, sf), on_unpaired="report")
    return rep.select("file", "uri", F.col("generation").cast("int").alias("generation"), "n_records",
                      F.array_join("missing", ",").alias("missing"))


_FETCH = r"(?im)^fetchTimeMs:[ \t]*([^\r\n]*)"


_PROJECTION_BODY = f"""SELECT rtrim(res_body, chr(0)) AS html, uri,
  coalesce(req_headers, '') || chr(13) || chr(10) || rtrim(req_body, chr(0)) AS req,
  coalesce(res_headers, '') AS res,
  strptime(req_date, '%Y-%m-%dT%H:%M:%SZ') AS "when",
  CASE WHEN NOT regexp_matches(meta_body, '{_FETCH}') THEN NULL
       WHEN trim(regexp_extract(meta_body, '{_FETCH}', 1)) = '' THEN NULL
       ELSE CAST(trim(regexp_extract(meta_body, '{_FETCH}', 1)) AS DOUBLE) / 1000.0 END AS duration
FROM x WHERE {_COMPLETE} AND regexp_matches(substr(res_body, 1, 1445), '{SNIFF_RE2}')
  AND NOT contains(rtrim(res_body, chr(0)), chr(0))"""


@register("exchange_projection", "C2 B2 B3 B7 B8 B9 T1", _GROUPS + _PROJECTION_BODY)
def q_exchange_projection(spark, sf):
    return X.html_exchange_dataset(_records(spark, sf), on_unpaired="drop")


@register(
    "exchange_exact",
    "J1 (records in file order)",
    _GROUPS + f"SELECT file, uri, generation, req_ordinal, res_ordinal, meta_ordinal FROM x WHERE {_COMPLETE}",
)
def q_exchange_exact(spark, sf):
    """The form an archive scan takes: whole files in order in each partition, paired without a further shuffle."""
    records = _records(spark, sf).repartition("file").sortWithinPartitions("file", "ordinal")
    ex = X.assemble_exchanges(records, on_unpaired="drop", in_order=True)
    return ex.select("file", "uri", F.col("generation").cast("int").alias("generation"), F.col("request.ordinal").alias("req_ordinal"),
                     F.col("response.ordinal").alias("res_ordinal"), F.col("metadata.ordinal").alias("meta_ordinal"))
