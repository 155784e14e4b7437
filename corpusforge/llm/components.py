"""Connected components by alternating large-star and small-star steps (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import ensure_checkpoint_dir


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component is named by its least node.

    Each step points the neighbours of a node at the least of them: first the greater ones, then the
    smaller ones.  The edges end as one star for each component; the number of steps grows with the
    logarithm of the longest path.  Every step is cut from its lineage by a reliable checkpoint.  Least
    neighbours are aggregated before the shuffle, and the join that hands them back to the edges has a
    checkpointed side, so Spark can split a node with very many edges.  Only a count and a checksum reach
    the driver.  Null ends, loops and repeated edges are allowed and have no effect.
    """
    ensure_checkpoint_dir(spark)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().checkpoint()
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).select("u", F.least("u", "least").alias("least")).checkpoint()
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct().checkpoint()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).checkpoint()
        moved = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b")
        now = moved.unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b"))).distinct().checkpoint()
        after = _state(now)
        if after == before:
            break
        before = after
    centers = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centers.select("node", F.col("node").alias("component")))
