"""Streaming forms equal their batch counterparts on the same input."""

from pyspark.sql import functions as F

from corpusforge.operators import crawl, exchange as X
from corpusforge.plans import fixtures as fx
from corpusforge.sources.crawl_index import select_crawl
from corpusforge.streaming import forms as W
from tests.conftest import SF_SMALL


def test_stream_host_tally_equals_batch(spark):
    idx = select_crawl(fx.index_of_pages(fx.table_stream(spark, SF_SMALL, "pages")), fx.CRAWL, "warc")
    got = W.run_available_now(W.stream_host_tally(idx), "t_tally", "complete")
    batch = crawl.host_summary(select_crawl(fx.crawl_index(spark, SF_SMALL), fx.CRAWL, "warc"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_exchanges_equal_exact_batch(spark):
    recs = fx.records_of_pages(fx.table_stream(spark, SF_SMALL, "pages"))
    got = W.run_available_now(W.stream_exchanges(recs, timeout_ms=None), "t_ex", "append").where("status = 'complete'")
    batch = X.assemble_exchanges(fx.archive_records(spark, SF_SMALL), on_unpaired="drop")
    a = sorted((r["file"], r["uri"], r["generation"], r["req_ordinal"]) for r in got.collect())
    b = sorted((r["file"], r["uri"], r["generation"], r["request"]["ordinal"]) for r in batch.collect())
    assert a == b and len(a) > 0


def test_trial_monitor_flags_and_bounded_state(spark):
    events = fx.table_stream(spark, SF_SMALL, "events")
    series = events.select(F.col("event_type").alias("cohort"), F.col("user_id").alias("trial_id"),
                           F.col("event_id").alias("seq"), F.col("ts").alias("t"), F.col("value").alias("metric"))
    mon = W.TrialMonitor(spark)
    W.stream_trials(series, mon)
    flags = mon.flags()
    n_trials = fx.trial_series(spark, SF_SMALL).select("cohort", "trial_id").distinct().count()
    assert flags.count() == n_trials
    assert mon.state().count() <= fx.trial_series(spark, SF_SMALL).count()


def test_archive_stream_into_exchange_pairing(spark):
    import os
    import tempfile

    from corpusforge.sources import warc as WS
    from tests.test_sources import _exchange

    d = tempfile.mkdtemp(dir="/tmp")
    WS.write_archive(os.path.join(d, "a-000.warc.gz"), _exchange("http://a.com/", b"<html>a</html>", 10) + _exchange("http://b.com/", b"<p >b</p>", 20)[:2])
    WS.write_archive(os.path.join(d, "a-001.warc.gz"), _exchange("http://c.com/", b"<b>c</b>", 30))
    stream = WS.stream_archives(spark, os.path.join(d, "*.warc.gz"))
    got = W.run_available_now(W.stream_exchanges(stream, timeout_ms=None), "t_arc", "append")
    rows = {(r["uri"], r["status"]) for r in got.collect()}
    assert rows == {("http://a.com/", "complete"), ("http://c.com/", "complete")}
    batch = X.assemble_exchanges(WS.read_archives(spark, os.path.join(d, "*.warc.gz")), on_unpaired="drop")
    assert {r["uri"] for r in batch.collect()} == {"http://a.com/", "http://c.com/"}


def test_tokenize_a_stream(spark):
    from corpusforge.operators import vocab as V
    from corpusforge.plans.q_vocab import SPEC, learned_vocab

    voc = learned_vocab(spark, SF_SMALL)
    docs = fx.table_stream(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = W.run_available_now(V.tokenize(docs, voc, SPEC, max_length=64).select("doc_id", "input_ids"), "t_tok", "append")
    batch = V.tokenize(fx.table(spark, SF_SMALL, "documents").select("doc_id", "text"), voc, SPEC, max_length=64)
    assert sorted((r["doc_id"], r["input_ids"]) for r in got.collect()) == sorted((r["doc_id"], r["input_ids"]) for r in batch.collect())


def test_trial_monitor_is_idempotent_and_resumes(spark):
    rows = [("c", i % 4, i, i * 1.0, float(i % 7)) for i in range(40)]
    batch = spark.createDataFrame(rows, "cohort string, trial_id long, seq long, t double, metric double")
    mon = W.TrialMonitor(spark)
    mon(batch, 0)
    mon(batch.limit(0), 1)
    mon(batch.limit(0), 1)  # a retried epoch rewrites the same folders
    # the trials that the first epoch flags are gone in the second
    flagged = mon.flags().where("epoch = 0 and outlier").count()
    assert flagged < 4 and mon.flags().count() == 4 + (4 - flagged)
    again = W.TrialMonitor(spark, root=mon.root)  # a restarted driver resumes from the files
    assert again.state().count() == mon.state().count()


def test_host_tally_merges_across_micro_batches(spark):
    import os
    import tempfile

    d = tempfile.mkdtemp(dir="/tmp")
    idx = fx.crawl_index(spark, SF_SMALL).drop("crawl", "subset")
    idx.where("page_id % 2 = 0").coalesce(1).write.parquet(os.path.join(d, "part-a"))
    idx.where("page_id % 2 = 1").coalesce(1).write.parquet(os.path.join(d, "part-b"))
    stream = (spark.readStream.schema(idx.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(d))
    got = W.run_available_now(W.stream_host_tally(stream), "t_upd", "update")
    # update mode emits a host again whenever a later batch changes it: keep the last row per host
    last = {}
    for r in got.collect():
        prev = last.get(r["hostname"])
        if prev is None or r["n"] >= prev["n"]:
            last[r["hostname"]] = r
    batch = {r["hostname"]: r for r in crawl.host_summary(idx).collect()}
    assert {h: (r["n"], r["n_root"], r["url"]) for h, r in last.items()} == {h: (r["n"], r["n_root"], r["url"]) for h, r in batch.items()}


def test_monitor_waits_for_the_roster_and_lets_trials_leave(spark):
    """No snapshot before every active trial has a point; errored trials leave the cohort, completed ones stay."""
    rows = {0: [("c", k, 1, 1.0, float(k)) for k in range(5)], 1: [("c", 5, 1, 1.0, 2.5), ("c", 0, 2, 2.0, 0.5)], 2: [("c", k, 3, 3.0, float(k)) for k in range(1, 6)]}
    active = {0: range(6), 1: range(6), 2: range(1, 6)}
    now = [0]
    schema = "cohort string, trial_id long, seq long, t double, metric double"

    def roster():
        return spark.createDataFrame([("c", k, k in active[now[0]]) for k in range(6)], "cohort string, trial_id long, active boolean")

    mon = W.TrialMonitor(spark, conf=0.0, roster=roster)
    flags = []
    for epoch, batch in rows.items():
        now[0] = epoch
        mon(spark.createDataFrame(batch, schema), epoch)
        flags.append({r.trial_id: r.metric for r in spark.read.parquet(f"{mon.root}/flags/epoch={epoch}").collect()})
    # trial 5 has no point yet; then all have; then trial 0 is gone and the others' newest common time is 3
    assert flags == [{}, {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 2.5}, {k: float(k) for k in range(1, 6)}]
    assert {r.t for r in mon.state().where("trial_id > 0").collect()} == {3.0}
