"""Exchange assembly: pair request, response and metadata records of one URI
within one archive file (J1, J2, E6) and project them to the HTML exchange
table (B2-B4, B7-B9, T1; pipeline C2).

A record opens an exchange of its URI or joins the open one; a type that repeats
before the exchange is complete replaces the earlier record; with all three types
the exchange is emitted.  No state crosses a file.

Pairing needs no payload: (file, URI, type, ordinal) alone are dealt out by file and
URI, so a large file is spread over many tasks, and read in ordinal order with one open
exchange.  Payloads of complete exchanges meet their pairs by (file, ordinal) afterwards.  An archive scan
of whole files is paired in its own tasks instead, without a shuffle; a task then holds the open
exchanges of one file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.charset import resolve_text
from corpusforge.functions.html import fetch_time_seconds, header_value, looks_like_html, parse_warc_date
from corpusforge.functions.text import strip_trailing_nul

# Fixed values from the reference: the record types that form one exchange.
REC_TYPES = ("request", "response", "metadata")


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_EXACT_COLS = ("file", "target_uri", "rec_type", "ordinal", "warc_date", "http_headers", "payload")
_SLOT_FIELDS = (("ordinal", "long"), ("warc_date", "string"), ("http_headers", "string"), ("payload", "binary"))
_EXACT_SCHEMA = "file string, uri string, generation int, n_records long, " + ", ".join(
    f"{t}_{f} {ty}" for t in REC_TYPES for f, ty in _SLOT_FIELDS
)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair records that come file by file in ordinal order; what a file leaves open comes out incomplete."""
    schema = pa.schema([(n, _ARROW[ty]) for n, ty in (c.split(" ") for c in _EXACT_SCHEMA.split(", "))])
    file, open_, done, rows = None, {}, {}, []

    def emit(uri, slots: dict) -> None:
        done[uri] = done.get(uri, 0) + 1
        row = {"file": file, "uri": uri, "generation": done[uri], "n_records": len(slots)}
        for t, rec in slots.items():
            row.update({f"{t}_{f}": rec[f] for f, _ in _SLOT_FIELDS})
        rows.append(row)

    def close() -> None:
        for uri, slots in open_.items():
            emit(uri, slots)
        open_.clear()
        done.clear()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        return out

    for records in batches:
        for rec in records.to_pylist():
            if rec["file"] != file:
                close()
                file = rec["file"]
            uri = rec["target_uri"]
            slots = open_.setdefault(uri, {})
            slots[rec["rec_type"]] = rec
            if len(slots) == len(REC_TYPES):
                emit(uri, open_.pop(uri))
        if rows:
            yield batch()
    close()
    if rows:
        yield batch()


def _pair_ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair (file, target_uri, rec_type, ordinal) rows that come in order of the first two and the ordinal: one exchange is open at a time."""
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(REC_TYPES)]
    place = {t: k for k, t in enumerate(REC_TYPES)}
    now, done, open_, rows = None, 0, [None] * len(REC_TYPES), []

    def close() -> None:
        if any(o is not None for o in open_):
            rows.append((*now, done + 1, *open_))

    for records in batches:
        for file, uri, kind, ordinal in zip(*(c.to_pylist() for c in records.columns), strict=True):
            if (file, uri) != now:
                close()
                now, done, open_ = (file, uri), 0, [None] * len(REC_TYPES)
            open_[place[kind]] = ordinal
            if None not in open_:
                done += 1
                rows.append((*now, done, *open_))
                open_ = [None] * len(REC_TYPES)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "uri", "generation", *REC_TYPES])
            rows = []
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "uri", "generation", *REC_TYPES])


def pair_records(records: DataFrame) -> DataFrame:
    """(file, uri, generation, request, response, metadata): the ordinals of each exchange, null where a record is missing."""
    keys = records.where(F.col("rec_type").isin(*REC_TYPES)).select("file", "target_uri", "rec_type", "ordinal")
    keys = keys.repartition("file", "target_uri").sortWithinPartitions("file", "target_uri", "ordinal")
    return keys.mapInArrow(_pair_ordinals, "file string, uri string, generation int, " + ", ".join(f"{t} long" for t in REC_TYPES))


def _with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Each exchange's ordinals replaced by structs of its records, met once by (file, ordinal)."""
    members = F.explode(F.array(*[F.struct(F.lit(t).alias("slot"), F.col(t).alias("ordinal")) for t in REC_TYPES])).alias("m")
    wanted = pairs.select("file", "uri", "generation", members).select("file", "uri", "generation", "m.slot", "m.ordinal").where("ordinal is not null")
    own = records.select(F.col("file").alias("f"), F.col("ordinal").alias("o"), "warc_date", "http_headers", "payload")
    met = wanted.join(own, F.col("file").eqNullSafe(F.col("f")) & (F.col("ordinal") == F.col("o")))
    record = F.struct("ordinal", F.col("uri").alias("target_uri"), "warc_date", "http_headers", "payload")
    return met.groupBy("file", "uri", "generation").agg(
        F.count(F.lit(1)).alias("n_records"), *[F.first(F.when(F.col("slot") == t, record), ignorenulls=True).alias(t) for t in REC_TYPES]
    )


def _groups_in_order(records: DataFrame) -> DataFrame:
    wanted = records.where(F.col("rec_type").isin(*REC_TYPES)).select(*_EXACT_COLS)
    flat = wanted.mapInArrow(_pair, _EXACT_SCHEMA)

    def rec(t: str):
        return F.when(
            F.col(f"{t}_ordinal").isNotNull(),
            F.struct(F.col(f"{t}_ordinal").alias("ordinal"), F.col("uri").alias("target_uri"),
                     F.col(f"{t}_warc_date").alias("warc_date"), F.col(f"{t}_http_headers").alias("http_headers"),
                     F.col(f"{t}_payload").alias("payload")),
        )

    return flat.select("file", "uri", "generation", "n_records", *[rec(t).alias(t) for t in REC_TYPES])


def assemble_exchanges(records: DataFrame, on_unpaired: str = "error", in_order: bool = False) -> DataFrame:
    """One row per (file, uri, generation) with ``request``/``response``/``metadata`` structs.

    ``on_unpaired``: ``error`` fails the job on an incomplete group, ``drop``
    keeps complete ones, ``report`` returns only the incomplete groups with the
    types they miss.  ``in_order`` says that every partition holds whole files in
    ordinal order, as the archive scan of whole files gives them: nothing is shuffled then.
    """
    if on_unpaired not in ("error", "drop", "report"):
        raise ValueError(f"unknown on_unpaired {on_unpaired!r}")
    groups = _groups_in_order(records) if in_order else pair_records(records)
    missing = F.array_compact(F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in REC_TYPES]))
    complete = F.size(missing) == 0
    if on_unpaired == "report":
        n_records = (F.lit(len(REC_TYPES)) - F.size(missing)).cast("long")
        return groups.where(~complete).select("file", "uri", "generation", n_records.alias("n_records"), missing.alias("missing"))
    if on_unpaired == "error":
        complete = F.when(complete, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("unpaired records for "), F.col("uri"), F.lit(" in "), F.col("file")))
        ).cast("boolean")
    groups = groups.where(complete)
    return groups if in_order else _with_records(groups, records)


def _content_type(headers: F.Column) -> F.Column:
    return header_value(headers, "content-type")


def _fields(payload: F.Column) -> F.Column:
    """The header fields of a metadata record: its text up to the first blank line; bytes that are no UTF-8 become U+FFFD."""
    text = F.make_valid_utf8(payload.cast("string"))
    return F.regexp_extract(text, r"(?s)^(.*?)(?:\r?\n\r?\n|\z)", 1)


def project_exchanges(exchanges: DataFrame, scoring: str = "compat") -> DataFrame:
    """(html, uri, req, res, when, duration) for exchanges whose response sniffs as HTML
    and whose decoded body holds no NUL after trailing NULs are stripped."""
    res, req, meta = F.col("response"), F.col("request"), F.col("metadata")
    html_ok = exchanges.where(looks_like_html(res["payload"]))
    body = resolve_text(res["payload"], _content_type(res["http_headers"]), scoring)["text"]
    req_body = resolve_text(req["payload"], _content_type(req["http_headers"]), scoring)["text"]
    out = html_ok.select(
        strip_trailing_nul(body).alias("html"),
        req["target_uri"].alias("uri"),
        F.concat(F.coalesce(req["http_headers"], F.lit("")), F.lit("\r\n"), strip_trailing_nul(req_body)).alias("req"),
        F.coalesce(res["http_headers"], F.lit("")).alias("res"),
        parse_warc_date(req["warc_date"]).alias("when"),
        fetch_time_seconds(_fields(meta["payload"])).alias("duration"),
    )
    return out.where(~F.contains(F.col("html"), F.lit("\u0000")))


def html_exchange_dataset(records: DataFrame, on_unpaired: str = "error", in_order: bool = False) -> DataFrame:
    """Pipeline C2: records -> complete exchanges -> HTML exchange rows."""
    return project_exchanges(assemble_exchanges(records, on_unpaired, in_order))
