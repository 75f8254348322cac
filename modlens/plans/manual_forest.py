"""Text to features to one forest per label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions.features import combined_features, tagged_features
from modlens.functions.identity import Lexicon, Sentiment
from modlens.operators import feature_batches, models
from modlens.operators.identity import identity_columns
from modlens.operators.normalise import clean_comments, normalise
from modlens.operators.splits import random_split
from modlens.session import checkpointed


def feature_table(
    comments: DataFrame,
    text_col: str = "text",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    clean: bool = True,
    stop_words: Sequence[str] | None = None,
    sentiment: Sentiment | None = None,
    tagged_col: str | None = None,
) -> DataFrame:
    """Comments with all 32 model inputs and ``normalized_text``.

    One map-only job: cleaning, identity columns, negation and polarity, text features. Cleaned texts are
    ASCII, so their features are made in Arrow batches; the rows are the same.
    """
    df = clean_comments(comments, text_col) if clean else comments
    if clean and sentiment is None and feature_batches.fits(lexicon):
        return tagged_features(feature_batches.batch_features(df, text_col, lexicon, stop_words), tagged_col)
    df = identity_columns(df, text_col, lexicon, sentiment)
    df = normalise(df, text_col, lexicon, stop_words)
    return combined_features(df, "normalized_text", tagged_col)


def train(
    features: DataFrame,
    labels: Sequence[str] = tuple(lx.LABELS),
    settings: models.ForestSettings = models.MANUAL,
    test_share: float = 0.2,
    seed: int = 42,
    key: str = "doc_id",
) -> models.Evaluation:
    """Split, scale on the training rows, fit and score one forest per label.

    The feature table is written to the shared folder first: it is read once per label.
    """
    columns = lx.FEATURE_COLUMNS
    table = checkpointed(
        random_split(features, test_share, key, seed).select(
            key, "is_test", *labels, *[F.col(c).cast("double").alias(c) for c in columns]
        )
    )
    train_rows = table.filter(~F.col("is_test"))
    test_rows = table.filter("is_test")
    by = models.moments(train_rows, columns)

    def prepare(df: DataFrame) -> DataFrame:
        return models.assemble(models.centred(df, by), columns)

    run = models.train_and_evaluate(prepare(train_rows), prepare(test_rows), labels, settings, columns, key=key)
    return replace(run, prepare=prepare)
