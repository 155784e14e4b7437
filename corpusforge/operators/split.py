"""Reproducible shuffle and splits.

Every row gets a salted 60-bit hash; order is (hash, key), which is total.
Exact-count splits need the k-th smallest (hash, key).  It is found without
moving rows to the driver: radix passes count the rows per 16-bit digit of the
hash inside the current prefix (a small group-by), narrowing to one hash
value in four passes over the narrow (hash, key) column pair, which is
checkpointed once so the passes do not recompute the input.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.hashing import DEFAULT_SEED, row_hash

DIGIT_BITS = 16
HASH_BITS = 64
# Fixed value from the reference: the share held out by the automatic split (half validation, half test).
HELD_FRACTION = 1 / 8


def shuffle(df: DataFrame, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Rows in salted-hash order (range-partitioned sort; reproducible, unlike an unseeded shuffle)."""
    return df.withColumn("h", row_hash(F.col(key), seed)).orderBy("h", key)


def kth_smallest(keys: DataFrame, k: int, h: str = "h", key: str = "key"):
    """(h, key) of the k-th smallest row (1-based) by (h, key); None when k is out of range."""
    if k <= 0:
        return None
    prefix, shift, rank = 0, HASH_BITS, k
    mask = (1 << DIGIT_BITS) - 1
    while shift > 0:
        nxt = shift - DIGIT_BITS
        inside = keys.where(F.shiftrightunsigned(F.col(h), shift) == F.lit(prefix)) if shift < HASH_BITS else keys
        counts = (
            inside.groupBy(F.shiftrightunsigned(F.col(h), nxt).bitwiseAND(F.lit(mask)).alias("d"))
            .agg(F.count(F.lit(1)).alias("c"))
            .orderBy("d")
            .collect()
        )
        for row in counts:
            if rank <= row["c"]:
                prefix = (prefix << DIGIT_BITS) | int(row["d"])
                break
            rank -= row["c"]
        else:
            return None
        shift = nxt
    # rows sharing this exact hash: count them per key (duplicated keys collapse to one row)
    ties = keys.where(F.col(h) == F.lit(prefix)).groupBy(key).agg(F.count(F.lit(1)).alias("c")).orderBy(key).collect()
    for row in ties:
        if rank <= row["c"]:
            return prefix, row[key]
        rank -= row["c"]
    return None


def _narrow(df: DataFrame, key: str, seed) -> DataFrame:
    return df.select(row_hash(F.col(key), seed).alias("h"), F.col(key).alias("key")).checkpoint(eager=True)


def _unique(narrow: DataFrame) -> None:
    """Exact counts need every key once: rows of one key cannot be told apart."""
    twice = narrow.groupBy("key").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"an exact split needs unique keys; {twice[0]['key']!r} occurs {twice[0]['count']} times")


def _le(h: F.Column, key: F.Column, th) -> F.Column:
    th_h, th_k = th
    return (h < F.lit(th_h)) | ((h == F.lit(th_h)) & (key <= F.lit(th_k)))


def holdout(df: DataFrame, key: str, n: int, seed: int = DEFAULT_SEED, name: str = "test", rest: str = "train",
            materialize: bool = False) -> DataFrame:
    """Exactly ``n`` rows (the smallest salted hashes) labelled ``name``, the rest ``rest``.

    ``materialize`` checkpoints an expensive input first, so finding the threshold
    and labelling the rows do not compute it twice.
    """
    if materialize:
        df = df.checkpoint(eager=True)
    if n <= 0:
        return df.withColumn("split", F.lit(rest))
    narrow = _narrow(df, key, seed)
    _unique(narrow)
    th = kth_smallest(narrow, n)
    h = row_hash(F.col(key), seed)
    if th is None:  # n >= row count: everything is held out
        return df.withColumn("split", F.lit(name))
    return df.withColumn("split", F.when(_le(h, F.col(key), th), F.lit(name)).otherwise(F.lit(rest)))


def auto_split(df: DataFrame, key: str, mode: str = "exact", seed: int = DEFAULT_SEED, held_fraction: float = HELD_FRACTION) -> DataFrame:
    """train / validation / test = 7/8, 1/16, 1/16.

    ``exact``: held-out = ceil(n/8) rows, test = ceil(held/2) of them, by two salted hashes.
    ``hash``: one pass by hash fraction; stable as data grows, counts approximate.
    """
    h1 = row_hash(F.col(key), seed)
    h2 = row_hash(F.col(key), f"{seed}:2")
    if mode == "hash":
        u1 = (h1 % 1_000_000).cast("double") / 1e6
        u2 = (h2 % 1_000_000).cast("double") / 1e6
        return df.withColumn(
            "split", F.when(u1 >= held_fraction, "train").when(u2 < 0.5, "test").otherwise("validation")
        )
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    narrow = df.select(h1.alias("h"), h2.alias("h2"), F.col(key).alias("key")).checkpoint(eager=True)
    _unique(narrow)
    n = narrow.count()
    held = math.ceil(n * held_fraction)
    n_test = math.ceil(held / 2)
    th1 = kth_smallest(narrow, held)
    if th1 is None:
        return df.withColumn("split", F.lit("train"))
    held_keys = narrow.where(_le(F.col("h"), F.col("key"), th1)).select(F.col("h2").alias("h"), "key")
    th2 = kth_smallest(held_keys, n_test)
    in_held = _le(h1, F.col(key), th1)
    in_test = _le(h2, F.col(key), th2) if th2 is not None else F.lit(True)
    return df.withColumn(
        "split", F.when(~in_held, F.lit("train")).when(in_test, F.lit("test")).otherwise(F.lit("validation"))
    )
