"""Text to padded id sequences, and scores to tuned predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.operators import metrics, profile
from modlens.operators.sequences import SequenceEncoder
from modlens.operators.splits import stratified_split
from modlens.session import checkpointed


@dataclass(frozen=True)
class EncodedSplit:
    """Encoder, sizes, and the encoded training and test rows."""

    encoder: SequenceEncoder
    max_features: int
    maxlen: int
    embed_size: int
    train: DataFrame
    test: DataFrame


def corpus_sizing(df: DataFrame, text_col: str = "text", mode: str = "reference") -> DataFrame:
    """One row: max_features, maxlen, embed_size. The texts are read once."""
    counts = checkpointed(profile.word_and_length_counts(df, text_col))
    words = counts.filter(F.col("word").isNotNull()).select("word", "n")
    lengths = counts.filter(F.col("word").isNull()).select("length", "n")
    return profile.sizing(profile.coverage(words, mode=mode), profile.histogram_stats(lengths))


def prepare(
    comments: DataFrame, stratum: str = "toxic", text_col: str = "text", key: str = "doc_id",
    test_share: float = 0.2, seed: int = 42,
) -> EncodedSplit:
    """Size the vocabulary, split, fit the word ids on the training rows, encode both parts."""
    comments = checkpointed(comments)  # read for the sizes, the word ids and the sequences
    size = corpus_sizing(comments, text_col).first()
    split = stratified_split(comments, stratum, test_share, key, seed)
    train_rows, test_rows = split.filter(~F.col("is_test")), split.filter("is_test")
    encoder = SequenceEncoder(size["max_features"], text_col, key).fit(train_rows, size["maxlen"])
    return EncodedSplit(
        encoder, size["max_features"], size["maxlen"], size["embed_size"],
        encoder.transform(train_rows), encoder.transform(test_rows),
    )


def tuned_predictions(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best threshold per label, and the scores with the class they give."""
    thresholds = metrics.best_thresholds(scores)
    return thresholds, metrics.apply_thresholds(scores, thresholds)
