from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """Column names become columns, Python scalars become literals."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)
