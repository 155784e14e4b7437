"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import prepare

#: Unicode ``White_Space`` as a regular-expression class body (fixed values): what the tokenizer libraries call white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, by position, so that other columns can clash with nothing."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def model_bytes(path: str) -> bytes:
    """A vocabulary file's bytes, read once by the driver (a few MB at most) and sent with the tasks."""
    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: {len(data)} bytes is too large to send with every task")
    return data


_LOADED: dict[tuple, object] = {}


def loaded(key: tuple, make):
    """One object per worker for ``key`` (a loaded model); the previous one is dropped when the key changes."""
    if key not in _LOADED:
        for old in [k for k in _LOADED if k[0] == key[0]]:
            del _LOADED[old]
        _LOADED[key] = make()
    return _LOADED[key]


def byte_slices(batch: pa.RecordBatch, column: int, limit: int):
    """Cut a record batch so that each slice holds about ``limit`` bytes of the string column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again: its lineage ends there."""
    import uuid

    from corpusforge.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
