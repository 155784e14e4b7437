"""Array column functions: stable softmax, argmax (first maximum), one-hot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions._util import as_col
from corpusforge.functions.text import let


def softmax(scores) -> Column:
    """exp(v - max) / sum(exp(v - max)), elementwise over an array<double>."""
    p = as_col(scores)
    # the maximum and the sum are bound once: an expression inside a lambda is evaluated for every element
    e = let(F.array_max(p), lambda m: F.transform(p, lambda v: F.exp(v - m)))
    return let(e, lambda x: let(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(x, lambda v: v / total)))


def argmax(scores) -> Column:
    """0-based position of the first maximum; null for an empty or null array."""
    p = as_col(scores)
    return F.when(F.size(p) > 0, (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def one_hot(index, width: int) -> Column:
    i = as_col(index)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))
