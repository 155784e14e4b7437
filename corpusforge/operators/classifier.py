"""Text classifier on (tokens, label) with pyspark.ml (M3): token counts into a
multinomial logistic regression, emitting raw class scores so the metric
bundle (A11) has real input."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_text_classifier(train: DataFrame, tokens: str = "tokens", label: str = "label",
                        vocab_size: int = 1 << 20, max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """One feature for each piece of the training rows; ``vocab_size`` bounds them far above any learned vocabulary."""
    cv = CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=vocab_size, minDF=1.0)
    lr = LogisticRegression(featuresCol="_tf", labelCol=label, family="multinomial", maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[cv, lr]).fit(train.select(tokens, F.col(label).cast("double").alias(label)))


def predict_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` plus ``scores`` (array<double>, one raw score per class)."""
    out = model.transform(df)
    return out.withColumn("scores", vector_to_array("rawPrediction")).drop("_tf", "rawPrediction", "probability", "prediction")
