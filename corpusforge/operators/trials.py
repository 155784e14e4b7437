"""Trial-series triage.

A series table is (cohort, trial_id, seq, t, metric).  Every step is a
partial-merging aggregate keyed by cohort or (cohort, trial), also those of the
Student t fit; its parameters, a few numbers for each cohort, stay a DataFrame.  In
Python (Arrow) run the fit of a cohort's bounded summary, the Newton steps from
merged sums and the distribution function of the values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.student_t import NU_RANGE, fit_weighted, newton_step, t_cdf

# Fixed value from the reference: outlier confidence (p at or below it flags a trial).
DEFAULT_CONF = 0.15


def latest_per_trial(series: DataFrame) -> DataFrame:
    """(cohort, trial_id, t, metric) of each trial's newest point (ties: the later inserted)."""
    newest = F.max_by(F.struct("t", "seq", "metric"), F.struct("t", "seq"))
    return series.groupBy("cohort", "trial_id").agg(newest.alias("p")).select(
        "cohort", "trial_id", F.col("p.t").alias("t"), F.col("p.metric").alias("metric")
    )


def best_trial(series: DataFrame, mode: str = "max") -> DataFrame:
    """Per cohort the trial whose latest metric is best, among finite ones; ties go to the smaller trial_id."""
    latest = latest_per_trial(series).where(F.abs("metric") < float("inf"))  # neither null, NaN nor infinite
    if mode == "max":
        key = F.struct(F.col("metric"), -F.col("trial_id"))
    elif mode == "min":
        key = F.struct(-F.col("metric"), -F.col("trial_id"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    pick = F.max_by(F.struct("trial_id", "metric"), key)
    return latest.groupBy("cohort").agg(pick.alias("b")).select(
        "cohort", F.col("b.trial_id").alias("trial_id"), F.col("b.metric").alias("metric")
    )


def common_snapshot(series: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Forward as-of snapshot per cohort.

    x = the smallest of the trials' newest times; each trial contributes its
    earliest point at or after x (equal times: the earlier inserted).  With a
    roster (cohort, trial_id[, active]), only active roster trials count, and a
    cohort where one of them has no point yet has no snapshot.
    """
    if roster is not None:
        # trials that errored or were removed (active = false) leave the cohort; completed ones stay
        if "active" in roster.columns:
            roster = roster.where(F.col("active"))
        roster = roster.select("cohort", "trial_id")
        series = series.join(roster, ["cohort", "trial_id"], "left_semi")
    last = series.groupBy("cohort", "trial_id").agg(F.max("t").alias("last_t"))
    if roster is not None:
        last = roster.join(last, ["cohort", "trial_id"], "left")
    x = last.groupBy("cohort").agg(
        F.min("last_t").alias("x"), F.count_if(F.col("last_t").isNull()).alias("waiting")
    ).where(F.col("waiting") == 0).select("cohort", "x")
    joined = series.join(x, "cohort")
    first = F.min_by(F.struct("t", "metric"), F.struct("t", "seq"))
    return (
        joined.where(F.col("t") >= F.col("x"))
        .groupBy("cohort", "trial_id", "x")
        .agg(first.alias("p"))
        .select("cohort", "trial_id", "x", F.col("p.t").alias("t"), F.col("p.metric").alias("metric"))
    )


#: Bins of the summary for each unit of asinh(distance from the median in robust scales).
BINS = 256
#: Newton steps over all values behind the fit of the summary, and the largest last step of a settled fit.
POLISH, SETTLED = 3, 1e-6
_PARAMETERS = "nu double, loc double, scale double, free boolean, moved double"
_PARAMETER_TYPE = T.StructType([T.StructField(c, T.BooleanType() if c == "free" else T.DoubleType()) for c in ("nu", "loc", "scale", "free", "moved")])


def _summary(rows: DataFrame) -> DataFrame:
    """(cohort, n, m, v): counts, means and variances of each cohort's values in bins around its median.

    The bins are narrow against the cohort's spread and grow with the distance, so a cohort of any size
    has a few thousand; equal values give their own count and no variance.
    """
    spread = rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("metric").alias("sd"), F.percentile_approx("metric", [0.25, 0.5, 0.75], 1000).alias("q")
    ).where("n >= 3 and sd > 0")
    robust = (F.col("q")[2] - F.col("q")[0]) / 1.349
    spread = spread.select("cohort", F.col("q")[1].alias("middle"), F.when(robust > 0, robust).otherwise(F.col("sd")).alias("width"))
    place = F.floor(F.asinh((F.col("metric") - F.col("middle")) / F.col("width")) * BINS)
    bins = rows.join(spread, "cohort").groupBy("cohort", place.alias("bin"))
    return bins.agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("m"), F.var_pop("metric").alias("v")).drop("bin")


def _fit_summary(table: pa.Table) -> pa.Table:
    """The fit of one cohort's bins; a bin with a variance stands for two values around its mean."""
    n, m, v = (np.asarray(table.column(c).combine_chunks(), dtype=float) for c in ("n", "m", "v"))
    apart = np.sqrt(np.maximum(v, 0.0))
    single = apart == 0
    y = np.concatenate([m[single], (m - apart)[~single], (m + apart)[~single]])
    count = np.concatenate([n[single], n[~single] / 2, n[~single] / 2])
    found = fit_weighted(y, count)
    columns = [table.column("cohort").slice(0, 0 if found is None else 1)]
    columns += [pa.array([] if found is None else [x], kind) for x, kind in zip(found or (0.0,) * 4, (pa.float64(),) * 3 + (pa.bool_(),), strict=True)]
    return pa.table([*columns, pa.array([None] * len(columns[1]), pa.float64())], names=["cohort", "nu", "loc", "scale", "free", "moved"])


@F.pandas_udf(_PARAMETER_TYPE)
def _stepped(n: pd.Series, wz: pd.Series, wqz: pd.Series, q: pd.Series, wq: pd.Series, logs: pd.Series,
             nu: pd.Series, loc: pd.Series, scale: pd.Series, free: pd.Series) -> pd.DataFrame:
    step, peak = newton_step(n, wz, wqz, q, wq, logs, scale, nu, free)
    size = np.abs(step).max(axis=1)
    step = step * np.where(peak, np.minimum(1.0, 1.0 / np.maximum(size, 1e-300)), 0.0)[:, None]
    return pd.DataFrame({
        "nu": np.clip(nu * np.exp(step[:, 2]), *NU_RANGE), "loc": loc + step[:, 0] * scale, "scale": scale * np.exp(step[:, 1]),
        "free": free, "moved": np.where(peak, size, np.inf),
    })


def _polished(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One Newton step of every cohort from sums over all its values, merged before the shuffle."""
    z = (F.col("metric") - F.col("loc")) / F.col("scale")
    terms = rows.join(fits, "cohort").withColumn("z", z).withColumn("r", F.col("z") * F.col("z") / F.col("nu")).withColumn("w", 1 / (1 + F.col("r")))
    w, q = F.col("w"), 1 - F.col("w")
    sums = terms.groupBy("cohort", "nu", "loc", "scale", "free").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(w * F.col("z")).alias("wz"), F.sum(w * q * F.col("z")).alias("wqz"),
        F.sum(q).alias("q"), F.sum(w * q).alias("wq"), F.sum(F.log1p("r")).alias("logs"),
    )
    new = _stepped("n", "wz", "wqz", "q", "wq", "logs", "nu", "loc", "scale", "free")
    return sums.select("cohort", new.alias("f")).select("cohort", "f.*")


def fit_cohorts(rows: DataFrame) -> DataFrame:
    """(cohort, nu, loc, scale, status): maximum-likelihood Student t of each cohort's finite values (cohort, metric).

    A mergeable summary of each cohort, a few thousand bins whatever its size, is fitted inside one
    task for each cohort.  Newton steps over all values follow, so the result is the fit of the values
    themselves; each is one aggregate of six sums, and the parameters stay a DataFrame.  ``status``:
    ``converged``; ``boundary``, the degrees of freedom are at an end of their range (the upper one is the
    normal distribution for all purposes); ``unconverged``, the last step was larger than ``SETTLED``.
    Cohorts with fewer than 3 values, without spread, or with no maximum but around a repeated value
    have no row.
    """
    kind = rows.schema["cohort"].dataType.simpleString()
    fits = _summary(rows).groupBy("cohort").applyInArrow(_fit_summary, f"cohort {kind}, {_PARAMETERS}")
    for _ in range(POLISH):
        fits = _polished(rows, fits)
    status = F.when(F.col("moved") > SETTLED, "unconverged").when(F.col("free"), "converged").otherwise("boundary")
    return fits.select("cohort", "nu", "loc", "scale", status.alias("status"))


@F.pandas_udf(T.DoubleType())
def _t_cdf_udf(x: pd.Series, nu: pd.Series, loc: pd.Series, scale: pd.Series) -> pd.Series:
    p = pd.Series(t_cdf(x, nu, loc, scale))
    return p.where(p.notna(), None)


def flag_outliers(series: DataFrame, mode: str = "max", conf: float = DEFAULT_CONF,
                  roster: DataFrame | None = None) -> DataFrame:
    """(cohort, trial_id, metric, p, outlier, status): fit Student t on the finite snapshot values of each cohort.

    ``status`` is that of the cohort's fit, or ``no fit``.  Values without a settled fit, and values that
    are not finite, have a null p and are no outliers.
    """
    snap = common_snapshot(series, roster).select("cohort", "trial_id", "metric").checkpoint(eager=True)
    finite = F.abs("metric") < float("inf")
    fits = fit_cohorts(snap.where(finite).select("cohort", "metric"))
    scored = snap.join(fits, "cohort", "left")
    status = F.coalesce("status", F.lit("no fit"))
    settled = finite & status.isin("converged", "boundary")
    p = _t_cdf_udf(F.when(settled, F.col("metric")), F.col("nu"), F.col("loc"), F.col("scale"))
    p = (F.lit(1.0) - p) if mode == "min" else p
    flags = scored.select("cohort", "trial_id", "metric", p.alias("p"), status.alias("status"))
    return flags.select("cohort", "trial_id", "metric", "p", F.coalesce(F.col("p") <= F.lit(conf), F.lit(False)).alias("outlier"), "status")


def triage_trials(series: DataFrame, mode: str = "max", conf: float = DEFAULT_CONF) -> DataFrame:
    """Pipeline C6: outlier flags plus each cohort's best trial by latest metric."""
    flags = flag_outliers(series, mode, conf)
    best = best_trial(series, mode).select("cohort", F.col("trial_id").alias("best_trial_id"))
    return flags.join(best, "cohort", "left")


def final_metrics(log: DataFrame, strict: bool = False) -> DataFrame:
    """Per run: the train row and the eval row logged at the run's last step.

    train: exactly one row with train_loss at the last step, else ``missing`` /
    ``ambiguous`` (``strict`` fails the job instead).  eval: ``missing`` means the
    run needs an evaluation pass.
    """
    last = log.groupBy("run_id").agg(F.max("step").alias("last_step"))
    at_last = log.join(last, "run_id").where(F.col("step") == F.col("last_step"))
    agg = at_last.groupBy("run_id", "last_step").agg(
        F.count_if(F.col("train_loss").isNotNull()).alias("n_train"),
        F.count_if(F.col("eval_loss").isNotNull()).alias("n_eval"),
        F.max("train_loss").alias("train_loss"),
        F.max("eval_loss").alias("eval_loss"),
    )

    def status(n):
        return F.when(n == 1, "ok").when(n == 0, "missing").otherwise("ambiguous")

    out = agg.select(
        "run_id", F.col("last_step").alias("step"),
        F.when(F.col("n_train") == 1, F.col("train_loss")).alias("train_loss"),
        F.when(F.col("n_eval") == 1, F.col("eval_loss")).alias("eval_loss"),
        status(F.col("n_train")).alias("train_status"), status(F.col("n_eval")).alias("eval_status"),
    )
    if strict:
        ok = F.when(F.col("train_status") == "ok", F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("no single final train row for run "), F.col("run_id").cast("string")))
        )
        out = out.where(ok.cast("boolean"))
    return out
