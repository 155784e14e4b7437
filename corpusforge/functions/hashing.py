"""Salted, reproducible row hashes shared by shuffles, batching and splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions._util import as_col

# Fixed value from the reference: the training seed, used as the default salt.
DEFAULT_SEED = 54321
HASH_HEX_DIGITS = 15  # 60-bit non-negative integers


def row_hash(key, seed: int | str = DEFAULT_SEED) -> Column:
    """Integer of the first 15 hex digits of md5('<seed>:<key>'): the same value in Spark and DuckDB."""
    s = F.concat(F.lit(f"{seed}:"), as_col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def row_hash_sql(key: str, seed: int | str = DEFAULT_SEED) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, {HASH_HEX_DIGITS})) AS BIGINT)"
