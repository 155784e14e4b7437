"""Sinks: typed Parquet corpus writer (K1), build-once materialization (K2),
vocabulary persistence (K3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference's corpus writer: GZIP codec, 256 rows per row group.
COMPAT_CODEC = "gzip"
COMPAT_ROWS_PER_GROUP = 256

CRAWL_SIZE_SCHEMA = T.StructType([
    T.StructField("sentence", T.StringType()), T.StructField("label", T.DoubleType()), T.StructField("hostname", T.StringType()),
])
HTML_EXCHANGE_SCHEMA = T.StructType([
    T.StructField("html", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("req", T.StringType()),
    T.StructField("res", T.StringType()), T.StructField("when", T.TimestampNTZType()), T.StructField("duration", T.DoubleType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the declared schema (names and order)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_corpus(df: DataFrame, path: str, schema: T.StructType, rows_per_group: int | None = None,
                 compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Write ``df`` with a declared schema.  ``rows_per_group=256, compression='gzip'``
    reproduces the reference files; the default keeps Parquet's own row-group sizing."""
    w = conform(df, schema).write.mode(mode).option("compression", compression)
    if rows_per_group is not None:
        w = w.option("parquet.block.row.count.limit", str(rows_per_group))
    w.parquet(path)


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def materialize(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """Return the table at ``path`` if a complete write (``_SUCCESS``) exists, else build and write it.

    A partial earlier write is overwritten, unlike a plain exists-check.
    """
    if not _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """LM blocks of several lengths, one folder per ``block_size`` (E4) so each model size reads only its own."""
    blocks.select("block_size", "input_ids", "attention_mask", "labels", *[c for c in ("split",) if c in blocks.columns]) \
        .write.mode(mode).partitionBy("block_size").parquet(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    vocab.select("id", "piece", "score", "type").write.mode(mode).parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "piece", "score", "type")
