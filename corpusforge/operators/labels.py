"""Labelled-text contract and label dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.split import auto_split

MAX_CLASSES = 1 << 16


def label_dictionary(df: DataFrame, name: str = "label_name", order: Sequence[str] | None = None) -> DataFrame:
    """(label_id, label_name): declared ``order`` if given, else sorted distinct names.

    The class count is checked before anything reaches the driver.
    """
    spark = df.sparkSession
    if order is None:
        names = df.select(F.col(name).alias("label_name")).where(F.col("label_name").isNotNull()).distinct()
        n = names.count()
        if n > MAX_CLASSES:
            raise ValueError(f"{n} classes exceed the label dictionary bound {MAX_CLASSES}")
        order = [r["label_name"] for r in names.orderBy("label_name").collect()]
    return spark.createDataFrame(list(enumerate(order)), "label_id INT, label_name STRING")


def encode_labels(df: DataFrame, dictionary: DataFrame, name: str = "label_name") -> DataFrame:
    """Attach ``label`` = label_id (a dimension join); rows with a null or unknown name stay, with a null label."""
    d = dictionary.select(F.col("label_name").alias(name), F.col("label_id").alias("label"))
    return df.join(d, [name], "left")


def labelled_dataset(df: DataFrame, key: str, text: str, name: str, split_col: str | None = None,
                     mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """(sentence, label, label_name, split) with its label dictionary.

    A given ``split_col`` must name a ``train`` split; ``validation`` absent means
    the train rows are auto-split (P3).
    """
    base = df.select(F.col(key), F.col(text).alias("sentence"), F.col(name).alias("label_name"),
                     *([F.col(split_col).alias("split")] if split_col else []))
    dictionary = label_dictionary(base)
    out = encode_labels(base, dictionary)
    if split_col is None:
        out = auto_split(out, key, mode=mode)
    else:
        has = out.agg(*(F.bool_or(F.col("split") == s).alias(s) for s in ("train", "validation"))).first()
        if not has["train"]:
            raise ValueError("a labelled dataset needs a train split")
        if not has["validation"]:
            train = auto_split(out.where(F.col("split") == "train").drop("split"), key, mode=mode)
            out = train.unionByName(out.where(~F.col("split").eqNullSafe("train")))
    return out, dictionary
