"""Charset study (A16): which detector's charset wins, against the declared one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.charset import resolve_text, winning_detector
from corpusforge.functions.html import content_type_charset


def charset_study(pages: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """(charset, detector, declared, n, avg_score, avg_bytes) over pages with a body and a Content-Type."""
    bound = pages.select(F.col(body).alias("body"), F.col(content_type).alias("content_type"), resolve_text(F.col(body), F.col(content_type)).alias("r"))
    rows = bound.select(
        "r.charset", "r.score", F.octet_length("body").alias("bytes"), content_type_charset(F.col("content_type")).alias("declared"),
        winning_detector(F.col("body"), F.col("r.charset"), F.col("content_type")).alias("detector"),
    )
    return rows.groupBy("charset", "detector", "declared").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.avg("bytes").alias("avg_bytes")
    )
