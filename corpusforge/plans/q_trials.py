"""Trial triage queries (J4 A13 A14 A15 C6) over the event table as trial series."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import trials as TR
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register

_S = f"WITH s AS ({fx.TRIAL_SERIES_SQL.strip()})"

_ASOF = _S + """,
last AS (SELECT cohort, trial_id, max(t) AS last_t FROM s GROUP BY ALL),
x AS (SELECT cohort, min(last_t) AS x FROM last GROUP BY cohort),
c AS (SELECT s.*, x.x, row_number() OVER (PARTITION BY s.cohort, s.trial_id ORDER BY s.t, s.seq) AS rn
      FROM s JOIN x USING (cohort) WHERE s.t >= x.x)
"""


def _series(spark, sf):
    return fx.trial_series(spark, sf)


@register("asof_snapshot", "J4", _ASOF + "SELECT cohort, trial_id, x, t, metric FROM c WHERE rn = 1")
def q_asof_snapshot(spark, sf):
    return TR.common_snapshot(_series(spark, sf))


_LATEST = _S + """,
l AS (SELECT cohort, trial_id, t, metric,
        row_number() OVER (PARTITION BY cohort, trial_id ORDER BY t DESC, seq DESC) AS rn FROM s)
"""


@register("latest_per_trial", "A14", _LATEST + "SELECT cohort, trial_id, t, metric FROM l WHERE rn = 1")
def q_latest_per_trial(spark, sf):
    return TR.latest_per_trial(_series(spark, sf))


@register(
    "best_trial",
    "A14",
    _LATEST + """, b AS (SELECT cohort, trial_id, metric,
  row_number() OVER (PARTITION BY cohort ORDER BY metric DESC, trial_id) AS r FROM l WHERE rn = 1)
SELECT cohort, trial_id, metric FROM b WHERE r = 1""",
)
def q_best_trial(spark, sf):
    return TR.best_trial(_series(spark, sf), "max")


def training_log(spark, sf):
    """F-LOG: a training log per user (run): day of month as step; click/view/signup
    values as train loss, purchase values as eval loss, error rows carry neither."""
    e = fx.table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.dayofmonth("ts").alias("step"),
        F.when(F.col("event_type").isin("click", "view", "signup"), F.col("value")).alias("train_loss"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"),
    )


TRAINING_LOG_SQL = """
SELECT user_id AS run_id, CAST(dayofmonth(ts) AS INTEGER) AS step,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN value END AS train_loss,
  CASE WHEN event_type = 'purchase' THEN value END AS eval_loss
FROM events
"""


@register(
    "final_metrics",
    "A13",
    f"""WITH lg AS ({TRAINING_LOG_SQL.strip()}),
last AS (SELECT run_id, max(step) AS last_step FROM lg GROUP BY run_id),
a AS (SELECT lg.run_id, last.last_step AS step, count(train_loss) AS n_train, count(eval_loss) AS n_eval,
        max(train_loss) AS tl, max(eval_loss) AS el
      FROM lg JOIN last ON lg.run_id = last.run_id AND lg.step = last.last_step GROUP BY ALL)
SELECT run_id, step, CASE WHEN n_train = 1 THEN tl END AS train_loss, CASE WHEN n_eval = 1 THEN el END AS eval_loss,
  CASE WHEN n_train = 1 THEN 'ok' WHEN n_train = 0 THEN 'missing' ELSE 'ambiguous' END AS train_status,
  CASE WHEN n_eval = 1 THEN 'ok' WHEN n_eval = 0 THEN 'missing' ELSE 'ambiguous' END AS eval_status
FROM a""",
)
def q_final_metrics(spark, sf):
    return TR.final_metrics(training_log(spark, sf))


@register("trial_outliers", "A15 C6 J4 A14")
def q_trial_outliers(spark, sf):
    return TR.triage_trials(_series(spark, sf), "max", TR.DEFAULT_CONF)
