"""Error and confidence analysis: predictions joined with their texts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import scoring as sc
from modlens.operators.metrics import LABEL
from modlens.operators.profile import value_counts
from modlens.operators.ranking import top_k, top_k_per


def with_text(preds: DataFrame, docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Predictions with the text of their document."""
    return preds.join(docs.select(key, text_col), key)


def most_toxic(preds: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """Positive rows with the highest scores."""
    return top_k(preds.filter(F.col("y") == 1), [F.col("p").desc(), F.col(key)], k)


def least_toxic(preds: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """Negative rows with the lowest scores."""
    return top_k(preds.filter(F.col("y") == 0), [F.col("p").asc(), F.col(key)], k)


def false_positives(preds: DataFrame) -> DataFrame:
    """Predicted positive, truly negative."""
    return preds.filter((F.col("yhat") == 1) & (F.col("y") == 0))


def false_negatives(preds: DataFrame) -> DataFrame:
    """Predicted negative, truly positive."""
    return preds.filter((F.col("yhat") == 0) & (F.col("y") == 1))


def error_counts(preds: DataFrame) -> DataFrame:
    """Per label the number of false positives and false negatives."""
    y, h = F.col("y"), F.col("yhat")
    return preds.groupBy(LABEL).agg(
        F.count_if((h == 1) & (y == 0)).alias("false_positives"),
        F.count_if((h == 0) & (y == 1)).alias("false_negatives"),
    )


def misclassified(preds: DataFrame, k: int = 3, key: str = "doc_id") -> DataFrame:
    """Per label and true class the first ``k`` wrong predictions by key."""
    wrong = preds.filter(F.col("yhat") != F.col("y"))
    return top_k_per(wrong, [LABEL, "y"], [F.col(key)], k)


def confidence(preds: DataFrame) -> DataFrame:
    """Predictions with their confidence bin and readable class."""
    return preds.withColumns(
        {"confidence_level": sc.binned(F.col("p")), "actual": sc.class_name(F.col("y"))}
    )


def confidence_counts(preds: DataFrame) -> DataFrame:
    """Rows per confidence bin; bins without rows give 0."""
    names = [b[2] for b in lx.CONFIDENCE_BINS]
    return value_counts(confidence(preds), "confidence_level", categories=names)


def borderline_cases(preds: DataFrame) -> DataFrame:
    """Scores strictly between 0.4 and 0.6."""
    return confidence(preds).filter(sc.borderline(F.col("p")))


def high_confidence_correct(preds: DataFrame) -> DataFrame:
    """Confident and right."""
    return confidence(preds).filter(sc.confidently_right(F.col("p"), F.col("y")))


def confident_positives(preds: DataFrame, floor: float = 0.9) -> DataFrame:
    """Positive rows with a score above the floor."""
    return preds.filter((F.col("y") == 1) & (F.col("p") > floor))
