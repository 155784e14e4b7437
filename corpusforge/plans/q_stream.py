"""Streaming queries (W1-W3): file streams over the driver tables, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.plans import fixtures as fx
from corpusforge.plans.q_crawl import _FIRST_SQL, _with
from corpusforge.plans.q_exchange import _COMPLETE, _GROUPS, _PROJECTION_BODY
from corpusforge.plans.registry import register
from corpusforge.sources.crawl_index import select_crawl
from corpusforge.streaming import forms as W


@register("stream_host_tally", "W1", _with(_FIRST_SQL, "SELECT hostname, n FROM tally"))
def q_stream_host_tally(spark, sf):
    idx = select_crawl(fx.index_of_pages(fx.table_stream(spark, sf, "pages")), fx.CRAWL, "warc")
    out = W.run_available_now(W.stream_host_tally(idx), "host_tally", "complete")
    return out.select("hostname", F.col("n").cast("bigint").alias("n"))


@register(
    "stream_exchange",
    "W2",
    _GROUPS + f"SELECT file, uri, generation, req_ordinal, res_ordinal, meta_ordinal FROM x WHERE {_COMPLETE}",
)
def q_stream_exchange(spark, sf):
    recs = fx.records_of_pages(fx.table_stream(spark, sf, "pages"))
    out = W.run_available_now(W.stream_exchanges(recs, timeout_ms=None), "exchanges", "append")
    return out.where(F.col("status") == "complete").select(
        "file", "uri", "generation", F.col("req_ordinal"), F.col("res_ordinal"), F.col("meta_ordinal")
    )


@register("stream_exchange_projection", "W2 C2", _GROUPS + _PROJECTION_BODY)
def q_stream_exchange_projection(spark, sf):
    recs = fx.records_of_pages(fx.table_stream(spark, sf, "pages"))
    out = W.project_stream_exchanges(W.stream_exchanges(recs, timeout_ms=None))
    return W.run_available_now(out, "exchange_rows", "append")


@register("stream_trials", "W3")
def q_stream_trials(spark, sf):
    events = fx.table_stream(spark, sf, "events")
    series = events.select(
        F.col("event_type").alias("cohort"), F.col("user_id").alias("trial_id"), F.col("event_id").alias("seq"),
        F.col("ts").alias("t"), F.col("value").alias("metric"),
    )
    monitor = W.TrialMonitor(spark)
    W.stream_trials(series, monitor)
    return monitor.flags()
