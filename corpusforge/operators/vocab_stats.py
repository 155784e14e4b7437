"""Statistics over a vocabulary table (id, piece, score, type) and over documents under it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import prefix_trim

# Fixed value from the reference: multiplier applied to the average token length.
TRIM_FACTOR = 1.5


def word_vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Whitespace-word unigram vocabulary: (piece, n, score = ln(n / total), type='NORMAL').

    One aggregate over the words; the total is a single scalar.
    """
    words = docs.select(F.explode(F.split(F.col(text), " ")).alias("piece")).where(F.col("piece") != "")
    counts = words.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    return counts.select(
        "piece", "n", (F.log(F.col("n").cast("double")) - F.log(F.lit(float(max(total, 1))))).alias("score"),
        F.lit("NORMAL").alias("type"),
    )


def avg_token_len_col(vocab: DataFrame) -> DataFrame:
    """One row: sum of len(piece) * exp(score) over pieces where that product is below 1."""
    w = F.length("piece") * F.exp(F.col("score").cast("double"))
    return vocab.agg(F.sum(F.when(w < 1, w).otherwise(F.lit(0.0))).alias("raw"))


def avg_token_len(vocab: DataFrame, factor: float = TRIM_FACTOR) -> float:
    """Scalar length hint (A12): ``factor * raw``; the vocabulary is driver-size."""
    raw = avg_token_len_col(vocab).collect()[0]["raw"] or 0.0
    return factor * raw


def trim_for_encoding(docs: DataFrame, max_length: int, hint: float, text: str = "text") -> DataFrame:
    """Keep only the prefix the tokenizer can need (T7), below any Python stage."""
    return docs.withColumn(text, prefix_trim(F.col(text), max_length, F.lit(hint)))


def trim_calibration(docs: DataFrame, raw_avg: float, seq_len: int, q: float = 0.95, text: str = "text",
                     accuracy: int = 1_000_000) -> DataFrame:
    """Smallest multiplier that keeps the first ``seq_len`` word tokens for a ``q`` share of documents.

    Per document the needed characters are those of its first ``seq_len`` words;
    the quantile is ``percentile_approx``: bounded memory, and a rank off by at most one
    part in ``accuracy`` of the rows.
    """
    first = F.array_join(F.slice(F.split(F.col(text), " "), 1, seq_len), " ")
    ratio = F.length(first).cast("double") / F.lit(seq_len * raw_avg)
    return docs.select(ratio.alias("r")).agg(F.percentile_approx("r", q, accuracy).alias("factor"))
