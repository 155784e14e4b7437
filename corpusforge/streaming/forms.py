"""Structured Streaming forms.

W1  incremental host tally: the batch aggregation on a streaming frame; the
    state store keeps one partial aggregate per host.
W2  incremental exchange assembly: ``applyInPandasWithState`` keyed by
    (file, uri); open exchanges live in state, complete ones are emitted, and
    an exchange left open past the timeout is emitted as ``unpaired``.
W3  trial monitor: ``foreachBatch`` merges the new points into a state table,
    recomputes snapshot, flags and best trial, and writes them per epoch
    (idempotent on retry, resumable after a driver restart).  Points older
    than the cohort's snapshot time can never be chosen again (that time only
    grows), so the state table is pruned to them and stays bounded.

State and checkpoints live under the reliable checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusforge.operators.crawl import host_summary
from corpusforge.operators.exchange import REC_TYPES
from corpusforge.operators.trials import best_trial, common_snapshot, flag_outliers
from corpusforge.session import ensure_checkpoint_dir


def _stream_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def run_available_now(sdf: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming frame over everything available into a Parquet table under the checkpoint folder and return it.

    Each micro-batch overwrites its own folder, so a retry repeats nothing; in ``complete`` mode the
    newest batch is the table.
    """
    spark = sdf.sparkSession
    root = _stream_dir(spark, name)

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/epoch={epoch}")

    q = (
        sdf.writeStream.foreachBatch(store).outputMode(output_mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    epochs = _committed_epochs(spark, f"{root}/table")
    if output_mode == "complete":
        epochs = epochs[-1:]
    if not epochs:
        return spark.createDataFrame([], sdf.schema)
    return spark.read.schema(sdf.schema).parquet(*(f"{root}/table/epoch={e}" for e in epochs))


# ------------------------------------------------------------------ W1
def stream_host_tally(index_stream: DataFrame) -> DataFrame:
    """Streaming host summary (complete/update output modes)."""
    return host_summary(index_stream)


# ------------------------------------------------------------------ W2
_FIELDS = ("ordinal", "warc_date", "http_headers", "payload")
_FIELD_TYPES = {"ordinal": "long", "warc_date": "string", "http_headers": "string", "payload": "binary"}
_SLOTS = [(t[:3] if t != "metadata" else "meta", t) for t in REC_TYPES]
STATE_SCHEMA = "generation int, " + ", ".join(f"{p}_{f} {_FIELD_TYPES[f]}" for p, _ in _SLOTS for f in _FIELDS)
EXCHANGE_SCHEMA = "file string, uri string, generation int, status string, " + ", ".join(
    f"{p}_{f} {_FIELD_TYPES[f]}" for p, _ in _SLOTS for f in _FIELDS
)


def _empty_slots() -> dict:
    return {f"{p}_{f}": None for p, _ in _SLOTS for f in _FIELDS}


def _pair_records(timeout_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        file, uri = key
        if state.hasTimedOut:
            (gen, *vals) = state.get
            slots = dict(zip([f"{p}_{f}" for p, _ in _SLOTS for f in _FIELDS], vals))
            state.remove()
            if all(slots[f"{p}_ordinal"] is None for p, _ in _SLOTS):
                return
            yield pd.DataFrame([{"file": file, "uri": uri, "generation": gen + 1, "status": "unpaired", **slots}])
            return
        if state.exists:
            (gen, *vals) = state.get
            slots = dict(zip([f"{p}_{f}" for p, _ in _SLOTS for f in _FIELDS], vals))
        else:
            gen, slots = 0, _empty_slots()
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values("ordinal")
        out = []
        by_type = dict(_SLOTS[i][::-1] for i in range(len(_SLOTS)))
        for row in batch.itertuples(index=False):
            prefix = by_type.get(row.rec_type)
            if prefix is None:
                continue
            for f in _FIELDS:  # a repeated type before completion overwrites
                slots[f"{prefix}_{f}"] = getattr(row, f)
            if all(slots[f"{p}_ordinal"] is not None for p, _ in _SLOTS):
                gen += 1
                out.append({"file": file, "uri": uri, "generation": gen, "status": "complete", **slots})
                slots = _empty_slots()
        # the generation counter stays in state until the timeout, so a later batch goes on with it
        if gen or any(slots[f"{p}_ordinal"] is not None for p, _ in _SLOTS):
            state.update((gen, *[slots[f"{p}_{f}"] for p, _ in _SLOTS for f in _FIELDS]))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame(out)

    return fn


def stream_exchanges(records_stream: DataFrame, timeout_ms: int | None = 10 * 60 * 1000) -> DataFrame:
    """Complete exchanges as they form; open ones past ``timeout_ms`` come out as ``unpaired``.

    ``timeout_ms=None`` keeps open exchanges in state without a timer: use it for
    bounded ``availableNow`` runs, which otherwise keep firing empty batches to
    service the timers.
    """
    recs = records_stream.where(F.col("rec_type").isin(*REC_TYPES)).select(
        "file", "target_uri", "rec_type", *_FIELDS
    )
    return recs.groupBy("file", "target_uri").applyInPandasWithState(
        _pair_records(timeout_ms), EXCHANGE_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


# ------------------------------------------------------------------ W3
def _committed_epochs(spark: SparkSession, path: str) -> list[int]:
    """Epoch numbers of ``path/epoch=N`` folders holding a complete write (``_SUCCESS``)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


class TrialMonitor:
    """foreachBatch sink keeping a bounded series state and writing flags per micro-batch.

    Everything an epoch produces goes to ``.../epoch=N`` folders written in
    overwrite mode, state last: a retried micro-batch rewrites the same folders
    (idempotent), and a restarted driver resumes from the newest committed state.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, mode: str = "max", conf: float = 0.15,
                 roster: Callable[[], DataFrame] | None = None):
        """``roster`` is asked in every micro-batch for the trials (cohort, trial_id, active) known by then: a cohort has no
        snapshot before each active trial has a point, and trials that are no longer active (errored, removed) leave."""
        self.spark = spark
        self.roster = roster
        self.root = root or _stream_dir(spark, "trials")
        self.mode = mode
        self.conf = conf

    def _latest(self, before: int | None = None) -> int | None:
        done = [e for e in _committed_epochs(self.spark, f"{self.root}/state") if before is None or e < before]
        return done[-1] if done else None

    def state(self, before: int | None = None) -> DataFrame | None:
        e = self._latest(before)
        return None if e is None else self.spark.read.parquet(f"{self.root}/state/epoch={e}")

    def _removed(self, before: int) -> DataFrame | None:
        e = self._latest(before)
        return None if e is None else self.spark.read.schema("cohort string, trial_id long").parquet(f"{self.root}/removed/epoch={e}")

    def flags(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/flags")

    def _no_decrease(self, rows: DataFrame) -> None:
        bad = rows.where(F.col("t") < F.col("prev_t")).limit(1).collect()
        if bad:
            raise ValueError(f"time decreased for trial {bad[0]['trial_id']} in cohort {bad[0]['cohort']}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        cols = ["cohort", "trial_id", "seq", "t", "metric"]
        new = batch.select(*cols)
        back = F.lag("t").over(Window.partitionBy("cohort", "trial_id").orderBy("seq"))
        self._no_decrease(new.withColumn("prev_t", back))
        prev = self.state(before=epoch)
        removed = self._removed(before=epoch)
        if prev is not None:
            new = new.join(removed, ["cohort", "trial_id"], "left_anti")
            last = prev.groupBy("cohort", "trial_id").agg(F.max("t").alias("prev_t"))
            self._no_decrease(new.join(last, ["cohort", "trial_id"]))
            series = prev.unionByName(new)
        else:
            series = new
        series = series.checkpoint(eager=True)
        roster = None
        if self.roster is not None:
            roster = self.roster().where("active").select("cohort", "trial_id").distinct()
            if removed is not None:
                roster = roster.join(removed, ["cohort", "trial_id"], "left_anti")
            roster = roster.checkpoint(eager=True)
        flags = flag_outliers(series, self.mode, self.conf, roster)
        best = best_trial(series, self.mode).select("cohort", F.col("trial_id").alias("best_trial_id"))
        flags = flags.join(best, "cohort", "left").checkpoint(eager=True)
        flags.write.mode("overwrite").parquet(f"{self.root}/flags/epoch={epoch}")
        flagged = flags.where("outlier").select("cohort", "trial_id")
        gone = flagged if removed is None else removed.unionByName(flagged).distinct()
        gone.write.mode("overwrite").parquet(f"{self.root}/removed/epoch={epoch}")
        # bounded state: keep points at or after the snapshot time (each trial's newest point included)
        if roster is not None:
            roster = roster.join(flagged, ["cohort", "trial_id"], "left_anti")
        snap = common_snapshot(series, roster).select("cohort", "x").distinct()
        kept = series.join(flagged, ["cohort", "trial_id"], "left_anti").join(snap, "cohort", "left")
        kept = kept.where(F.col("x").isNull() | (F.col("t") >= F.col("x"))).drop("x")
        kept.write.mode("overwrite").parquet(f"{self.root}/state/epoch={epoch}")


def stream_trials(series_stream: DataFrame, monitor: TrialMonitor) -> None:
    q = (
        series_stream.writeStream.foreachBatch(monitor)
        .option("checkpointLocation", f"{monitor.root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def project_stream_exchanges(exchanges_stream: DataFrame) -> DataFrame:
    """(html, uri, req, res, when, duration) from streamed complete exchanges (C2 as a stream)."""
    from corpusforge.operators.exchange import project_exchanges

    def rec(prefix: str):
        return F.struct(
            F.col(f"{prefix}_ordinal").alias("ordinal"), F.col("uri").alias("target_uri"),
            F.col(f"{prefix}_warc_date").alias("warc_date"), F.col(f"{prefix}_http_headers").alias("http_headers"),
            F.col(f"{prefix}_payload").alias("payload"),
        )

    complete = exchanges_stream.where(F.col("status") == "complete")
    shaped = complete.select(rec("req").alias("request"), rec("res").alias("response"), rec("meta").alias("metadata"))
    return project_exchanges(shaped)
