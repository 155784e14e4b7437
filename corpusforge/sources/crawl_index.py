"""Crawl-index source (S1): Hive-partitioned Parquet with ``crawl`` and ``subset`` partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_COLUMNS = ("url", "url_host_name", "warc_filename", "warc_record_offset", "warc_record_length")


def select_crawl(index: DataFrame, crawl: str, subset: str = "warc") -> DataFrame:
    """Keep one crawl and subset; on a partitioned scan these become partition filters."""
    return index.where((F.col("crawl") == crawl) & (F.col("subset") == subset))


def read_crawl_index(spark: SparkSession, root: str, crawl: str, subset: str = "warc") -> DataFrame:
    """Read only the five index columns of one crawl/subset.

    Partition pruning and column pruning are Catalyst's: the scan lists only the
    matching ``crawl=/subset=`` folders and reads only the selected columns.
    Offsets are widened to BIGINT whatever width the files use.
    """
    df = spark.read.option("basePath", root).parquet(root)
    df = select_crawl(df, crawl, subset)
    return df.select(
        "url",
        "url_host_name",
        "warc_filename",
        F.col("warc_record_offset").cast("bigint").alias("warc_record_offset"),
        F.col("warc_record_length").cast("bigint").alias("warc_record_length"),
    )
