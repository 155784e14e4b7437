"""Words between white space, counted where the texts are read.

A text meets Arrow's own splitter and hash table a batch at a time, so what is made of a word is made once for
each distinct one, and only words with counts leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words and counts that a task gathers before it merges them, and rows that leave it at a time.
KEPT_BYTES = 64 << 20
BATCH_ROWS = 1 << 16

COLUMNS = ["word", "n", "kept"]


def _counted(texts: pa.Array, n: int, kept: int) -> pa.Table:
    # the splitter also parts words at a vertical tab, which the normalizer removes as it removes this other character
    texts = pc.replace_substring(texts, "\x0b", "\x01")
    found = pc.value_counts(pc.ascii_split_whitespace(texts).flatten())
    often = found.field("counts")
    words = pa.table([found.field("values").cast(pa.string()), pc.multiply(often, n), pc.multiply(often, kept)], names=COLUMNS)
    return words.filter(pc.field("word") != "")


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        text, whole, cut = batch.columns
        whole = whole.fill_null(False)
        for texts, n, kept in ((text.filter(whole), 1, 1), (text.filter(pc.invert(whole)), 1, 0), (cut.drop_null(), 0, 1)):
            if len(texts):
                yield _counted(texts, n, kept)


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum"), ("kept", "sum")]).rename_columns(COLUMNS)


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in _parts(batches):
        held.append(part)
        size += part.nbytes
        if size >= KEPT_BYTES:
            held = [_merged(held)]
            size = held[0].nbytes
            if size >= KEPT_BYTES // 2:
                yield from held[0].to_batches(BATCH_ROWS)
                held, size = [], 0
    if held:
        yield from _merged(held).to_batches(BATCH_ROWS)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, kept) of rows (text, whole, cut): how often each word between ASCII white space occurs.

    ``n`` counts all texts, ``kept`` the texts marked ``whole`` and what others were ``cut`` to; null texts have no words.
    """
    counts = rows.mapInArrow(_word_rows, "word string, n long, kept long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
