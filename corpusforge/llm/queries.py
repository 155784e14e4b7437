"""One query per operator, over its whole table with production parameters, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_piece_codec")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.piece_codec import encode_decode

    rows = encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


#: host, path and verdict of the rules that the query is asked to judge by (fixed values)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.quality_rules import judge_quality

    rows, name = judge_quality(spark, table(spark, sf_dir, "documents"), carry=["doc_id"])
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return rows.select("doc_id", *(F.col(f"`{name[c]}`").alias(c) for c in wanted))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _place_sql(url: str) -> str:
    """host and path of a URL expression."""
    return rf"""coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"""


def _node_sql(url: str) -> str:
    return rf"""CASE WHEN contains({url}, '://') THEN lower(regexp_extract({url}, '(?s)^(.*?)://', 1)) || '://'
    || translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"""


_ROOT, _QUERY = r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)"

# rules by suffix and prefix; all links to canonical and refresh targets, resolved against the page's URL; what each node reaches over them, to and fro
URL_FILTER_SQL = rf"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
pg AS (SELECT page_id, {_node_sql("url")} AS node, {_place_sql("url")} FROM pages),
targets AS (
  SELECT url, replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
      lambda tag: regexp_extract(tag, '(?i)<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
      lambda tag: regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?\s*\d+\s*;\s*url\s*=\s*["'']?([^"''\s>]+)', 1)))), '&amp;', '&') AS t
  FROM pages WHERE contains(url, '://')),
cut AS (
  SELECT url, t, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t END AS whole,
    coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') AS own,
    regexp_extract(t, '(?s)^([^?#]*)', 1) AS path, regexp_extract(t, '(?s)^[^?#]*(\?[^#]*)', 1) AS rest
  FROM targets WHERE t <> ''),
aimed AS (
  SELECT url, CASE WHEN whole IS NOT NULL THEN regexp_extract(whole, '{_ROOT}', 1) ELSE regexp_extract(url, '{_ROOT}', 1) END AS root,
    CASE WHEN whole IS NOT NULL THEN regexp_extract(whole, '(?s)^.*?://[^/?#]*([^?#]*)', 1) WHEN starts_with(path, '/') THEN path
      WHEN path <> '' THEN regexp_extract(own, '(?s)^(.*/)', 1) || path ELSE own END AS path,
    CASE WHEN whole IS NOT NULL THEN regexp_extract(whole, '{_QUERY}', 1) WHEN path = '' AND rest = '' THEN regexp_extract(url, '{_QUERY}', 1) ELSE rest END AS query
  FROM cut WHERE whole IS NOT NULL OR NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:')),
whole AS (
  SELECT url, root || CASE WHEN regexp_matches(path, '/\.{{1,2}}(/|$)') THEN coalesce(nullif(
      list_reduce(string_split(path, '/')[2:], lambda kept, part: CASE WHEN part = '..' THEN regexp_replace(kept, '/[^/]*$', '') WHEN part = '.' THEN kept ELSE kept || '/' || part END, '')
      || CASE WHEN regexp_matches(path, '/\.{{1,2}}$') THEN '/' ELSE '' END, ''), '/') ELSE path END || query AS t
  FROM aimed),
links AS (SELECT {_node_sql("url")} AS a, {_node_sql("t")} AS b FROM whole),
both_ways AS (SELECT a, b FROM links WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM links WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
places AS (SELECT host, path FROM pg UNION SELECT host, path FROM (SELECT {_place_sql("b")} FROM reach)),
ruled AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
spread AS (
  SELECT a, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked
  FROM (SELECT a, {_place_sql("b")} FROM reach) JOIN ruled USING (host, path) GROUP BY a)
SELECT page_id, pg.host, pg.path, ruled.rule, coalesce(ruled.verdict, CASE WHEN spread.blocked THEN 'block' END, 'allow') AS verdict
FROM pg LEFT JOIN ruled ON pg.host = ruled.host AND pg.path = ruled.path LEFT JOIN spread ON pg.node = spread.a
"""


@query("op9_url_filter", URL_FILTER_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.url_filter import html_links, judge_urls

    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(spark, pages, rules, html_links(pages))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.simhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.language_id import held_out, learn, predicted

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(learn(docs)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op7_pii_spans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.pii import detected, learn

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", detected(learn(docs)).alias("p"))
    return rows.select("doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone", F.sha2("p.base", 256).alias("base_sha256"), F.col("p.spans").alias("spans"))


@query("op2_page_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.page_text import main_text

    return main_text(spark, table(spark, sf_dir, "pages"))


@query("op4_cross_polytope")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.cross_polytope import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(spark, vectors, F.col("vec_id") % 50 == 0)


#: words one by one with the window that starts there; a word goes if a covered window starts at most 49 words before it
BLOCK_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (
  SELECT doc_id, w[k] AS word, k, CASE WHEN k + 49 <= len(w) THEN md5(array_to_string(w[k:k + 49], ' ')) END AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
low AS (SELECT h, min(doc_id) AS low FROM word WHERE h IS NOT NULL GROUP BY h),
marked AS (SELECT doc_id, word, k, max(CASE WHEN doc_id > low THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS last FROM word LEFT JOIN low USING (h)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY k) AS kept FROM marked WHERE coalesce(k - last >= 50, true) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op13_block_repeats", BLOCK_REPEATS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.block_repeats import remove_repeats

    rows = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _codebook_sql(rounds: int = 4) -> str:
    """Every part against every entry of its codebook, round by round."""
    steps = [
        """WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS p FROM (SELECT vec_id, v, unnest(range(0, 4)) AS part FROM kept)),
c0 AS MATERIALIZED (SELECT part, entry, p AS c FROM (SELECT part, p, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry FROM cut) WHERE entry < 256)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min([list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i]))), entry]) AS best
  FROM cut JOIN c{k} USING (part) GROUP BY vec_id, part)"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS (SELECT part, entry, list(CAST(floor(total / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY i) AS c FROM (
  SELECT part, best[2] AS entry, i, sum(p[i]) AS total, count(*) AS n FROM (SELECT part, best, p, unnest(range(1, len(p) + 1)) AS i FROM a{k} JOIN cut USING (vec_id, part))
  GROUP BY part, best[2], i) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.entry, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} ON c{k}.part = s{k}.part AND c{k}.entry = s{k}.entry)"""
            )
    final = f"""coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(best[2] AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM a{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"""
    return ",\n".join([*steps, final])


@query("op11_slice_codes", _codebook_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from corpusforge.llm.common import written
    from corpusforge.llm.slice_codes import compress

    rows, books = compress(spark, table(spark, sf_dir, "embeddings"), carry=("label",))
    rows = written(spark, rows)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    sums = rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


@query("op12_lanczos_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusforge.llm.lanczos_whitening import whiten

    return whiten(spark, table(spark, sf_dir, "embeddings"))
