"""Confusion-matrix metrics: accuracy, multi-class MCC, and Rpb (MCC of the
softmax-weighted matrix), optionally per group.

The matrix is kept in long form ``(by..., ref, pred, weight)``: at most N*N rows
per group, produced by a partial + final aggregate over the predictions.  The
class statistics then fold into one row per group with the identities
``sum x(n-x) = n^2 - sum x^2`` and ``sum (d n - x y) = n sum d - sum x y``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.arrays import argmax, softmax


def confusion(df: DataFrame, scores: str = "scores", ref: str = "ref", soft: bool = False,
              by: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Long-form confusion matrix (by..., ref, pred, weight).

    Hard: one count per (ref, argmax).  Soft: row ``ref`` accumulates softmax(scores).
    With ``width`` the hard matrix is completed to the full width x width grid with zeros.
    """
    by = list(by)
    if soft:
        cells = (
            df.select(*by, F.col(ref).alias("ref"), F.posexplode(softmax(F.col(scores))).alias("pred", "w"))
            .groupBy(*by, "ref", "pred")
            .agg(F.sum("w").alias("weight"))
        )
        return cells
    cells = (
        df.select(*by, F.col(ref).alias("ref"), argmax(F.col(scores)).alias("pred"))
        .groupBy(*by, "ref", "pred")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    if width is None:
        return cells
    groups = cells.select(*by).distinct() if by else None
    grid = _expand_grid(groups, width) if by else _expand_grid(df.sparkSession.range(1).select(), width)
    return grid.join(cells, [*by, "ref", "pred"], "left").select(
        *by, "ref", "pred", F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight")
    )


def _expand_grid(groups: DataFrame, width: int) -> DataFrame:
    """width x width cells for every group, generated in place (no join)."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(width * width - 1)))
    return groups.select("*", cells.alias("_c")).select(
        *groups.columns, (F.col("_c") / width).cast("int").alias("ref"), (F.col("_c") % width).cast("int").alias("pred")
    )


def mcc_from_cells(cells: DataFrame, by: Sequence[str] = (), name: str = "mcc", with_totals: bool = False) -> DataFrame:
    """Multi-class MCC per group from long-form cells; 0 when the denominator is not positive."""
    by = list(by)
    w = F.col("weight")
    roles = F.explode(
        F.array(
            F.struct(F.col("ref").alias("k"), w.alias("y"), F.lit(0.0).alias("x"),
                     F.when(F.col("ref") == F.col("pred"), w).otherwise(F.lit(0.0)).alias("d")),
            F.struct(F.col("pred").alias("k"), F.lit(0.0).alias("y"), w.alias("x"), F.lit(0.0).alias("d")),
        )
    )
    per_class = (
        cells.select(*by, roles.alias("r"))
        .groupBy(*by, F.col("r.k").alias("k"))
        .agg(F.sum("r.y").alias("y"), F.sum("r.x").alias("x"), F.sum("r.d").alias("d"))
    )
    g = per_class.groupBy(*by).agg(
        F.sum("y").alias("n"), F.sum("d").alias("dd"), F.sum(F.col("x") * F.col("y")).alias("xy"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
    n = F.col("n")
    den = (n * n - F.col("xx")) * (n * n - F.col("yy"))
    value = F.when(den > 0, (n * F.col("dd") - F.col("xy")) / F.sqrt(den)).otherwise(F.lit(0.0))
    extra = [n, F.col("dd")] if with_totals else []
    return g.select(*by, value.alias(name), *extra)


def _both_cells(df: DataFrame, scores: str, ref: str, by: list[str]) -> DataFrame:
    """Hard and soft cells from one scan: (by..., kind, ref, pred, weight)."""
    p = softmax(F.col(scores))
    contrib = F.concat(
        F.array(F.struct(F.lit("hard").alias("kind"), argmax(F.col(scores)).alias("pred"), F.lit(1.0).alias("w"))),
        F.transform(p, lambda v, i: F.struct(F.lit("soft").alias("kind"), i.alias("pred"), v.alias("w"))),
    )
    return (
        df.select(*by, F.col(ref).alias("ref"), F.explode(contrib).alias("c"))
        .groupBy(*by, F.col("c.kind").alias("kind"), "ref", F.col("c.pred").alias("pred"))
        .agg(F.sum("c.w").alias("weight"))
    )


def accuracy(df: DataFrame, scores: str = "scores", ref: str = "ref", by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    hit = F.when(argmax(F.col(scores)) == F.col(ref), 1).otherwise(0)
    return df.groupBy(*by).agg(F.try_divide(F.sum(hit).cast("double"), F.count(F.lit(1)).cast("double")).alias("acc"))


def evaluate(df: DataFrame, scores: str = "scores", ref: str = "ref", by: Sequence[str] = ()) -> DataFrame:
    """(by..., acc, mcc, rpb): the metric bundle per group, one scan and no joins.

    mcc is computed on the hard matrix, rpb on the soft one; accuracy is the hard
    diagonal over the total (null on empty input).
    """
    by = list(by)
    cells = _both_cells(df, scores, ref, by)
    per_kind = mcc_from_cells(cells, [*by, "kind"], "m", with_totals=True)
    hard = F.col("kind") == "hard"
    return per_kind.groupBy(*by).agg(
        F.max(F.when(hard, F.try_divide(F.col("dd"), F.col("n")))).alias("acc"),
        F.max(F.when(hard, F.col("m"))).alias("mcc"),
        F.max(F.when(~hard, F.col("m"))).alias("rpb"),
    )
