"""Linguistic, bias and TF-IDF columns side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.arrays import with_fields
from modlens.functions.features import bias_pattern_counts, linguistic_features, pos_counts
from modlens.functions.identity import Lexicon
from modlens.operators.tfidf import fit_tfidf
from modlens.session import checkpointed


def engineered_features(
    df: DataFrame,
    text_col: str = "normalized_text",
    lexicon: Lexicon | None = None,
    tagged_col: str | None = None,
    max_features: int = 10_000,
    width: int = 100,
) -> DataFrame:
    """The frame with linguistic columns, bias counts if a lexicon is given, and a TF-IDF block.

    Tag counts and the dependency distance need a column of tagged tokens. After the vocabulary
    is fitted, all columns are added row by row; nothing is joined.
    """
    df = checkpointed(df)  # read for the vocabulary and again for the columns
    out = linguistic_features(df, text_col)
    if tagged_col is not None:
        out = with_fields(out, pos_counts(F.col(tagged_col)))
    if lexicon:
        terms = [t for ts in lexicon.values() for t in ts]
        out = with_fields(out, bias_pattern_counts(F.col(text_col), terms))
    return fit_tfidf(df, text_col, max_features).block(out, width, text_col)
