"""Vectors to one forest per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.operators import models
from modlens.operators.splits import stratified_split


def train(
    vectors: DataFrame,
    labels: DataFrame,
    label_names: Sequence[str] = tuple(lx.LABELS),
    vector_col: str = "embedding",
    stratum: str = "toxic",
    settings: models.ForestSettings = models.EMBEDDING,
    test_share: float = 0.2,
    seed: int = 42,
    key: str = "doc_id",
) -> models.Evaluation:
    """Join vectors and labels by key, split by stratum, fit and score one forest per label."""
    joined = models.vectorised(vectors.select(key, vector_col), vector_col).join(labels, key)
    split = stratified_split(joined, stratum, test_share, key, seed)
    return models.train_and_evaluate(
        split.filter(~F.col("is_test")), split.filter("is_test"), label_names, settings, key=key
    )
