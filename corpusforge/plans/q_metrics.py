"""Metric queries over score vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.arrays import argmax, softmax
from corpusforge.operators import metrics as M
from corpusforge.plans import fixtures as fx
from corpusforge.plans.registry import register

W = 64  # components of an embedding
_S = {"s": fx.SCORED_PREDICTIONS_SQL}

_SOFT_SQL = """
sm AS (SELECT vec_id, ref, grp, list_transform(scores, lambda v: exp(v - list_max(scores))) AS e FROM s),
p AS (SELECT vec_id, ref, grp, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm)
"""
_ARGMAX = "CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER)"


def _q(extra: str, body: str) -> str:
    ctes = [f"s AS ({_S['s'].strip()})"] + ([extra.strip()] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _mcc_sql(cells: str, by: str = "") -> str:
    """MCC per group from a cells relation (by..., ref, pred, weight)."""
    g = f"{by}, " if by else ""
    return f"""
SELECT {g}CASE WHEN (n*n - xx) * (n*n - yy) > 0 THEN (n*dd - xy) / sqrt((n*n - xx) * (n*n - yy)) ELSE 0.0 END AS m,
       n, dd
FROM (
  SELECT {g}sum(y) AS n, sum(d) AS dd, sum(x*y) AS xy, sum(x*x) AS xx, sum(y*y) AS yy FROM (
    SELECT {g}k, sum(y) AS y, sum(x) AS x, sum(d) AS d FROM (
      SELECT {g}ref AS k, weight AS y, 0.0 AS x, CASE WHEN ref = pred THEN weight ELSE 0.0 END AS d FROM {cells}
      UNION ALL SELECT {g}pred AS k, 0.0, weight, 0.0 FROM {cells}
    ) GROUP BY {g}k
  ) GROUP BY ALL
)"""


def _scores(spark, sf):
    return fx.scored_predictions(spark, sf)


@register("softmax", "T11", _q(_SOFT_SQL, "SELECT vec_id, list_transform(p, lambda v: round(v, 6)) AS probs FROM p"))
def q_softmax(spark, sf):
    return _scores(spark, sf).select("vec_id", F.transform(softmax("scores"), lambda v: F.round(v, 6)).alias("probs"))


@register("argmax", "T12", _q("", f"SELECT vec_id, {_ARGMAX} AS pred FROM s"))
def q_argmax(spark, sf):
    return _scores(spark, sf).select("vec_id", argmax("scores").alias("pred"))


_HARD_CELLS = f"""
cnt AS (SELECT ref, {_ARGMAX} AS pred, CAST(count(*) AS DOUBLE) AS weight FROM s GROUP BY ALL),
grid AS (SELECT CAST(a AS INTEGER) AS ref, CAST(b AS INTEGER) AS pred FROM range({W}) r1(a), range({W}) r2(b)),
hard AS (SELECT g.ref, g.pred, coalesce(c.weight, 0.0) AS weight FROM grid g LEFT JOIN cnt c USING (ref, pred))
"""
_SOFT_CELLS = _SOFT_SQL + """,
soft AS (SELECT ref, CAST(i - 1 AS INTEGER) AS pred, sum(p[i]) AS weight
         FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) GROUP BY ALL)
"""


@register("confusion_hard", "A6", _q(_HARD_CELLS, "SELECT ref, pred, weight FROM hard"))
def q_confusion_hard(spark, sf):
    return M.confusion(_scores(spark, sf), soft=False, width=W).select("ref", "pred", "weight")


@register("confusion_soft", "A7", _q(_SOFT_CELLS, "SELECT ref, pred, round(weight, 6) AS weight FROM soft"))
def q_confusion_soft(spark, sf):
    c = M.confusion(_scores(spark, sf), soft=True)
    return c.select("ref", F.col("pred").cast("int").alias("pred"), F.round("weight", 6).alias("weight"))


@register("accuracy", "A8", _q("", f"SELECT round(avg(CASE WHEN {_ARGMAX} = ref THEN 1.0 ELSE 0.0 END), 6) AS acc FROM s"))
def q_accuracy(spark, sf):
    return M.accuracy(_scores(spark, sf)).select(F.round("acc", 6).alias("acc"))


@register("mcc", "A9", _q(_HARD_CELLS, f"SELECT round(m, 6) AS mcc FROM ({_mcc_sql('hard')})"))
def q_mcc(spark, sf):
    cells = M.confusion(_scores(spark, sf), soft=False)
    return M.mcc_from_cells(cells).select(F.round("mcc", 6).alias("mcc"))


@register("rpb", "A10", _q(_SOFT_CELLS, f"SELECT round(m, 6) AS rpb FROM ({_mcc_sql('soft')})"))
def q_rpb(spark, sf):
    cells = M.confusion(_scores(spark, sf), soft=True)
    return M.mcc_from_cells(cells, name="rpb").select(F.round("rpb", 6).alias("rpb"))


_BY_CELLS = f"""
hc AS (SELECT grp, ref, {_ARGMAX} AS pred, CAST(count(*) AS DOUBLE) AS weight FROM s GROUP BY ALL),
{_SOFT_SQL.strip()},
sc AS (SELECT grp, ref, CAST(i - 1 AS INTEGER) AS pred, sum(p[i]) AS weight
       FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) GROUP BY ALL)
"""


@register(
    "metrics_by_group",
    "A11 C5",
    _q(_BY_CELLS, f"""SELECT h.grp, round(h.dd / h.n, 6) AS acc, round(h.m, 6) AS mcc, round(s2.m, 6) AS rpb
FROM ({_mcc_sql('hc', 'grp')}) h JOIN ({_mcc_sql('sc', 'grp')}) s2 USING (grp)"""),
)
def q_metrics_by_group(spark, sf):
    ev = M.evaluate(_scores(spark, sf), by=["grp"])
    return ev.select("grp", *[F.round(c, 6).alias(c) for c in ("acc", "mcc", "rpb")])
