"""Fixed-size batching, block packing and truncate/pad.

Batches are deterministic: rows are hashed into buckets, numbered inside their bucket by (hash, key),
and cut every ``batch_size`` rows.  Buckets are the leaves of an extendible-hash directory: a bucket that
outgrows its bound is split by the next bit of the hash, and the others stay as they are.  Every later window and aggregate is
clustered by (bucket, batch, ...).  Block packing deals batches out anew, over as many tasks as the rows need: a
task's memory does not grow with the table, whatever the session's number of shuffle partitions.

Block packing never gathers a batch: each document is cut into the slices
that fall into each block of its batch, and only slices of one block meet in
a group, so a group holds at most ``block_size`` tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions.hashing import DEFAULT_SEED, HASH_HEX_DIGITS, row_hash

# Fixed value from the reference: rows per batch for tokenizing, packing and padding.
BATCH_SIZE = 256
#: Most rows that share a bucket when the number of buckets is not given.
BUCKET_ROWS = 1 << 16
#: Rows that share a task, about: batches of packing, and leaves of numbering where the number of buckets is given.
TASK_ROWS = 1 << 12
#: Bits of the hash that may tell buckets apart.
_BITS, _MOST_BITS = 4 * HASH_HEX_DIGITS, 30


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows; all cores get one."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _directory(hashes: DataFrame, rows: int) -> tuple[int, list[tuple[int, int]], int]:
    """Bits of a prefix, (prefix, bucket) and the number of all rows: a bucket is a hash prefix with at most ``rows`` rows, one bit longer than one with more.

    A bucket's number is its prefix behind a leading one.  Rows of one hash cannot be told apart and stay together.
    """
    bits = 0
    while True:
        prefix = F.shiftright("h", _BITS - bits).cast("int") if bits else F.lit(0)
        # bounded: a few for each bucket
        count = {r["p"]: r["n"] for r in hashes.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        most = max(count.values(), default=0)
        if most <= rows or bits == _MOST_BITS:
            break
        bits = min(_MOST_BITS, bits + max(1, math.ceil(math.log2(most / rows))))
    level, counts = bits, {bits: count}
    while level:
        up: dict[int, int] = {}
        for p, n in counts[level].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        level -= 1
        counts[level] = up
    out = []
    for p in sorted(count):
        depth = 0
        while depth < bits and counts[depth][p >> (bits - depth)] > rows:
            depth += 1
        out.append((p, (1 << depth) | (p >> (bits - depth))))
    return bits, out, sum(count.values())


def _with_leaves(df: DataFrame, name: str, bits: int, leaves: list[tuple[int, int]]) -> DataFrame:
    """``df`` with its hash's leaf of a directory; rows without a hash are in leaf 1."""
    if not bits:
        return df.withColumn(name, F.lit(1))
    leaf = df.sparkSession.createDataFrame(leaves, f"_prefix int, `{name}` int")
    out = df.withColumn("_prefix", F.shiftright("h", _BITS - bits).cast("int")).join(F.broadcast(leaf), "_prefix", "left").drop("_prefix")
    return out.withColumn(name, F.coalesce(name, F.lit(1)))


def with_batches(df: DataFrame, key: str, batch_size: int = BATCH_SIZE, buckets: int | None = None,
                 seed: int = DEFAULT_SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add (h, bucket, rn, batch): rn counts from 1 inside a bucket in (h, key) order.

    Without ``buckets`` there are as many as the rows need, with at most ``bucket_rows`` each: the batches
    depend on the rows alone, not on the session, and further rows change the buckets they fall into and no other.

    With ``buckets``, however few, a leaf of a bucket, at most ``bucket_rows`` and ``TASK_ROWS``, is numbered alone, and the
    counts of the leaves before it are added: leaves are ranges of hashes, so that gives the numbers of the whole bucket.
    """
    out = df.withColumn("h", row_hash(F.col(key), seed))
    leaf_rows = bucket_rows if buckets is None else min(bucket_rows, TASK_ROWS)
    bits, leaves, rows = _directory(out.where("h is not null").select("h"), leaf_rows)
    if buckets is None:
        out = _with_leaves(out, "bucket", bits, leaves)
        number = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    elif not bits:
        out = out.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
        number = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    else:
        out = _with_leaves(out.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int")), "_leaf", bits, leaves)
        # one row for each leaf of each bucket; rows without a hash have no bucket and are numbered alone
        sizes = out.where("h is not null").groupBy("bucket", "_leaf").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low")).collect()
        before, total = [], {}
        for r in sorted(sizes, key=lambda r: r["low"]):
            before.append((r["bucket"], r["_leaf"], total.get(r["bucket"], 0)))
            total[r["bucket"]] = before[-1][2] + r["n"]
        start = df.sparkSession.createDataFrame(before, "bucket int, _leaf int, _before long")
        out = out.join(F.broadcast(start), ["bucket", "_leaf"], "left")
        out = out.repartition(_tasks(df.sparkSession, rows), "bucket", "_leaf")
        number = (F.row_number().over(Window.partitionBy("bucket", "_leaf").orderBy("h", key)) + F.coalesce("_before", F.lit(0))).cast("int")
    out = out.withColumn("rn", number).withColumn("batch", ((F.col("rn") - 1) / batch_size).cast("int"))
    return out.select(*df.columns, "h", "bucket", "rn", "batch")


def _field(name: str):
    return lambda p: p[name]


def pack_blocks(df: DataFrame, block_size: int | Sequence[int], cols: Sequence[str] = ("input_ids", "attention_mask"),
                group: Sequence[str] = ("bucket", "batch"), order: str = "rn") -> DataFrame:
    """Concatenate the token arrays of each batch and cut them into blocks.

    A batch totalling at least ``block_size`` tokens keeps only whole blocks (the
    tail is dropped); a shorter non-empty batch yields one short block; an empty
    one yields nothing.  ``labels`` is a copy of the first column (E3).
    ``block_size`` may be a list (E4): each size packs the same batches.

    The rows are counted first: a task packs the batches of about ``TASK_ROWS`` of them, in every size.
    """
    group = list(group)
    cols = list(cols)
    sizes = [int(block_size)] if isinstance(block_size, int) else [int(b) for b in block_size]
    n = F.size(F.col(cols[0]))
    w_run = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group)
    base = (
        df.select(*group, order, *cols)
        .repartition(_tasks(df.sparkSession, df.select(order).count()), *group)
        .withColumn("_len", n)
        .withColumn("_off", F.coalesce(F.sum("_len").over(w_run), F.lit(0)))
        .withColumn("_total", F.sum("_len").over(w_all))
        .where(F.col("_len") > 0)
    )
    if len(sizes) == 1:
        base = base.withColumn("block_size", F.lit(sizes[0]))
    else:
        base = base.withColumn("block_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    b = F.col("block_size")
    total = F.col("_total")
    n_blocks = F.when(total >= b, (total / b).cast("int")).otherwise(F.lit(1))
    first = (F.col("_off") / b).cast("int")
    last = F.least(((F.col("_off") + F.col("_len") - 1) / b).cast("int"), n_blocks - 1)
    pieces = base.where(first <= last).select(
        *group, "block_size", order, *cols, "_off", "_len", F.explode(F.sequence(first, last)).alias("block")
    )
    lo = F.greatest(F.col("_off"), F.col("block") * b) - F.col("_off")
    hi = F.least(F.col("_off") + F.col("_len"), (F.col("block") + 1) * b) - F.col("_off")
    parts = pieces.select(
        *group, "block_size", "block",
        F.struct(F.col(order).alias("o"), *[F.slice(F.col(c), lo + 1, hi - lo).alias(c) for c in cols]).alias("p"),
    )
    packed = parts.groupBy(*group, "block_size", "block").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    out = packed.select(
        *group, "block_size", "block",
        *[F.flatten(F.transform("ps", _field(c))).alias(c) for c in cols],
    )
    return out.withColumn("labels", F.col(cols[0]))


def truncate_pad(df: DataFrame, max_length: int, pad_to: str = "batch", pad_id: int = 0,
                 ids: str = "input_ids", group: Sequence[str] = ("bucket", "batch")) -> DataFrame:
    """Cut ids to ``max_length``; pad to the batch's longest (``batch``) or to ``max_length`` (``max``).

    attention_mask is 1 on real tokens and 0 on padding.
    """
    cut = F.slice(F.col(ids), 1, max_length)
    out = df.withColumn(ids, cut).withColumn("_n", F.size(F.col(ids)))
    if pad_to == "batch":
        out = out.withColumn("_to", F.max("_n").over(Window.partitionBy(*group)))
    elif pad_to == "max":
        out = out.withColumn("_to", F.lit(max_length))
    else:
        raise ValueError(f"unknown pad_to {pad_to!r}")
    pad = F.greatest(F.col("_to") - F.col("_n"), F.lit(0))
    return (
        out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), pad)))
        .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), pad)))
        .drop("_n", "_to")
    )
