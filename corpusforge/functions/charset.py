"""Character-set detection, decoding and decode scoring.

Detection is native: BOM by byte prefix, the meta prescan by regex over the
latin-1 view of the first 1,024 bytes, the Content-Type parameter by regex.
Labels are normalized through a map literal built from Python's own codec
alias table (a rule over the standard library, not a hand list), plus the
few WHATWG label overrides the prescan applies.

Decoding: UTF-8 stays in the JVM (``make_valid_utf8`` equals Python's
``errors='replace'``); only rows with a non-UTF-8 candidate go through one
Arrow-batched pandas UDF, and the other rows reach it as nulls.
"""

from __future__ import annotations

import codecs
import encodings.aliases

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions._util import as_col
from corpusforge.functions.html import content_type_charset

PRESCAN_BYTES = 1024
REPLACEMENT = "�"

# WHATWG Encoding Standard labels whose codec differs from the
# Python alias of the same name (the prescan maps them this way), and the
# UTF-16 labels that the prescan turns into UTF-8.
WHATWG_OVERRIDES = {
    "cp1252": ["ascii", "us-ascii", "iso-8859-1", "iso8859-1", "iso_8859-1", "iso88591", "latin1", "l1",
               "cp819", "ibm819", "iso-ir-100", "csisolatin1", "ansi_x3.4-1968", "windows-1252", "x-cp1252"],
    "cp1254": ["iso-8859-9", "iso8859-9", "iso_8859-9", "iso88599", "latin5", "l5", "iso-ir-148", "csisolatin5", "windows-1254"],
    "cp874": ["tis-620", "iso-8859-11", "iso8859-11", "iso885911", "dos-874", "windows-874"],
    "gbk": ["gb2312", "gb_2312", "gb_2312-80", "chinese", "csgb2312", "x-gbk", "gbk", "iso-ir-58"],
    "utf-8": ["utf-16", "utf-16le", "utf-16be", "unicode", "ucs-2", "unicodefffe", "unicodefeff", "csunicode", "iso-10646-ucs-2"],
}


def _norm_key(label: Column) -> Column:
    """Python's codec-name normalization: lower case, punctuation runs to ``_``, trimmed."""
    low = F.lower(F.trim(label))
    key = F.regexp_replace(low, r"[^a-z0-9.]+", "_")
    return F.regexp_replace(key, r"^_+|_+$", "")


_CACHE: dict[str, dict[str, str]] = {}


def _python_codec_names() -> dict[str, str]:
    if "py" in _CACHE:
        return _CACHE["py"]
    out: dict[str, str] = {}
    keys = set(encodings.aliases.aliases) | set(encodings.aliases.aliases.values())
    for k in sorted(keys):
        try:
            out[k] = codecs.lookup(k).name
        except LookupError:
            continue
    for k in list(out):
        out.setdefault(k.replace(".", "_"), out[k])
    _CACHE["py"] = out
    return out


_MAP_SQL: dict[int, str] = {}


def _sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map_literal(d: dict[str, str]) -> Column:
    """One SQL map literal (a single expression, not one call per entry)."""
    key = id(d)
    sql = _MAP_SQL.get(key)
    if sql is None:
        sql = "map(" + ", ".join(f"{_sql_str(k)}, {_sql_str(d[k])}" for k in sorted(d)) + ")"
        _MAP_SQL[key] = sql
    return F.expr(sql)


def _whatwg_map() -> dict[str, str]:
    if "whatwg" in _CACHE:
        return _CACHE["whatwg"]
    out = {}
    for name, labels in WHATWG_OVERRIDES.items():
        for lab in labels:
            key = lab.lower()
            out[key] = name
    _CACHE["whatwg"] = out
    return out


def codec_name(label) -> Column:
    """Python codec name for a label, or null when Python does not know it."""
    return F.element_at(_map_literal(_python_codec_names()), _norm_key(as_col(label)))


def prescan_codec(label) -> Column:
    lab = F.lower(F.trim(as_col(label)))
    return F.coalesce(F.element_at(_map_literal(_whatwg_map()), lab), codec_name(lab))


def bom_charset(body) -> Column:
    h = F.hex(F.substring(as_col(body), 1, 3))
    return (
        F.when(h.startswith("EFBBBF"), F.lit("utf-8"))
        .when(h.startswith("FEFF"), F.lit("utf-16-be"))
        .when(h.startswith("FFFE"), F.lit("utf-16-le"))
        .otherwise(F.lit("utf-8"))
    )


_COMMENT = r"<!--(?s:.*?)-->"
_META_TAG = r"(?i)<meta[\s/][^>]*>"
_QUOTED = r"\"[^\"]*\"|'[^']*'"
_ATTR_CHARSET = r"(?i)[\s/]charset\s*=\s*[\"']?\s*([^\s\"';>/]+)"
_HTTP_EQUIV_CT = r"(?i)[\s/]http-equiv\s*=\s*[\"']?\s*content-type"
_CONTENT = r"(?i)[\s/]content\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"
_CONTENT_CHARSET = r"(?i)charset\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s;\"']+))"


def _meta_charset(tag: Column) -> Column:
    """Charset declared by one <meta> tag: its ``charset`` attribute, else the ``charset=``
    inside ``content`` when ``http-equiv`` is content-type (WHATWG prescan rules)."""
    bare = F.regexp_replace(tag, _QUOTED, '""')  # attribute names outside quoted values
    direct_raw = F.regexp_extract(tag, _ATTR_CHARSET, 1)
    content = F.regexp_extract(tag, _CONTENT, 1)
    content = F.regexp_replace(content, r"^[\"']|[\"']$", "")
    in_content = F.coalesce(
        F.nullif(F.regexp_extract(content, _CONTENT_CHARSET, 1), F.lit("")),
        F.nullif(F.regexp_extract(content, _CONTENT_CHARSET, 2), F.lit("")),
        F.nullif(F.regexp_extract(content, _CONTENT_CHARSET, 3), F.lit("")),
    )
    return (
        F.when(bare.rlike(r"(?i)[\s/]charset\s*="), F.nullif(direct_raw, F.lit("")))
        .when(bare.rlike(r"(?i)[\s/]http-equiv\s*=") & tag.rlike(_HTTP_EQUIV_CT) & content.rlike(_CONTENT_CHARSET), in_content)
    )


def prescan_label(body) -> Column:
    """Charset label declared by the first qualifying ``<meta>`` in the first 1,024 bytes (comments skipped)."""
    head = F.decode(F.substring(as_col(body), 1, PRESCAN_BYTES), "ISO-8859-1")
    head = F.regexp_replace(head, _COMMENT, "")
    tags = F.regexp_extract_all(head, F.lit(_META_TAG), 0)
    found = F.filter(F.transform(tags, _meta_charset), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def detect_charsets(body, content_type=None) -> Column:
    """Candidates in detector order: array<struct<rank, label, codec>>; codec null = unknown label."""
    b = as_col(body)
    pl = prescan_label(b)
    cands = [
        F.struct(F.lit(0).alias("rank"), bom_charset(b).alias("label"), bom_charset(b).alias("codec")),
        F.struct(F.lit(1).alias("rank"), pl.alias("label"), prescan_codec(pl).alias("codec")),
    ]
    if content_type is not None:
        cl = content_type_charset(as_col(content_type))
        cands.append(F.struct(F.lit(2).alias("rank"), cl.alias("label"), codec_name(cl).alias("codec")))
    arr = F.array(*cands)
    return F.filter(arr, lambda c: c["label"].isNotNull())


def replacement_count(text) -> Column:
    t = as_col(text)
    return F.length(t) - F.length(F.replace(t, F.lit(REPLACEMENT), F.lit("")))


def decode_score(text) -> Column:
    """Reference score ``len * (1 - 2 / (1 + r))``: clean texts score -len."""
    t = as_col(text)
    r = replacement_count(t)
    return F.length(t).cast("double") * (F.lit(1.0) - F.lit(2.0) / (F.lit(1.0) + r.cast("double")))


def utf8_text(body) -> Column:
    return F.make_valid_utf8(as_col(body).cast("string"))


_DECODED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("charset", T.StringType()), T.StructField("score", T.DoubleType())]
)


def _score(txt: str) -> float:
    r = txt.count(REPLACEMENT)
    return len(txt) * (1 - 2 / (1 + r))


@F.pandas_udf(_DECODED)
def _decode_candidates(body: pd.Series, codecs_: pd.Series, scoring: pd.Series) -> pd.DataFrame:
    texts, names, scores = [], [], []
    for data, cands, mode in zip(body, codecs_, scoring):
        if data is None or cands is None:
            texts.append(None), names.append(None), scores.append(None)
            continue
        data = bytes(data)
        best = None
        for rank, codec in enumerate(cands):
            try:
                txt = str(data, codec, "replace")
                sc = _score(txt)
            except (TypeError, LookupError):
                txt, sc = "", float("inf")
            if mode == "compat":
                key = (sc, rank)
            else:  # fewest replacement marks, then the shorter (less mojibake), then detector order
                key = (txt.count(REPLACEMENT) if sc != float("inf") else float("inf"), len(txt), rank)
            if best is None or key < best[0]:
                best = (key, txt, codec, sc)
        texts.append(best[1]), names.append(best[2]), scores.append(best[3])
    return pd.DataFrame({"text": texts, "charset": names, "score": scores})


# Marked non-deterministic so the optimizer never copies the call into a pushed-down
# filter (which would run the Python decode twice per row).
_DECODE = _decode_candidates.asNondeterministic()


DETECTORS = ("bom", "prescan", "content-type")


def winning_detector(body, charset, content_type=None) -> Column:
    """Name of the first detector whose candidate is the winning charset."""
    cands = detect_charsets(as_col(body), content_type)
    hit = F.filter(cands, lambda c: F.coalesce(c["codec"], c["label"]) == as_col(charset))
    names = F.array(*[F.lit(d) for d in DETECTORS])
    return F.try_element_at(names, F.try_element_at(hit, F.lit(1))["rank"] + 1)


def resolve_text(body, content_type=None, scoring: str = "compat") -> Column:
    """struct<text, charset, score>: the lowest-scoring decode over the distinct candidates.

    Unknown labels keep an infinite score; equal scores go to the earlier detector.
    ``scoring='fewest_replacements'`` orders by replacement count, then shortest.
    """
    if scoring not in ("compat", "fewest_replacements"):
        raise ValueError(f"unknown scoring {scoring!r}")
    b = as_col(body)
    cands = detect_charsets(b, content_type)
    known = F.array_distinct(F.transform(F.filter(cands, lambda c: c["codec"].isNotNull()), lambda c: c["codec"]))
    fast = F.forall(known, lambda c: c == F.lit("utf-8"))
    txt = utf8_text(b)
    native = F.struct(txt.alias("text"), F.lit("utf-8").alias("charset"), decode_score(txt).alias("score"))
    # distinct names in detector order; unknown labels stay (they score +inf)
    names = F.array_distinct(F.transform(cands, lambda c: F.coalesce(c["codec"], c["label"])))
    slow = _DECODE(F.when(~fast, b), F.when(~fast, names), F.lit(scoring))
    return F.when(b.isNull(), F.lit(None)).when(fast, native).otherwise(slow)
