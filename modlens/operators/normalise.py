"""Cleaning, negation marking and polarity columns of a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import negation as ng
from modlens.functions import text as tx
from modlens.functions.arrays import with_fields
from modlens.functions.identity import Lexicon


def clean_comments(
    df: DataFrame, text_col: str = "text", passes: Sequence = lx.SUBSTITUTION_PASSES
) -> DataFrame:
    """The frame with its text column cleaned; one pass, no shuffle."""
    return df.withColumn(text_col, tx.clean(F.col(text_col), passes))


def normalise(
    df: DataFrame,
    text_col: str = "text",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    stop_words: Sequence[str] | None = None,
    preserve_case: bool = True,
) -> DataFrame:
    """The frame with ``normalized_text`` and the four polarity columns; no shuffle."""
    terms = lx.distinct_terms(lexicon)
    text = F.col(text_col)
    out = with_fields(
        df,
        {
            "normalized_text": ng.mark_negation(text, terms, stop_words, preserve_case),
            "_pol": ng.polarity(text, terms),
        },
    )
    return out.select("*", "_pol.*").drop("_pol")


def toxic_with_identity(df: DataFrame, label: str = "toxic") -> DataFrame:
    """Rows of the positive class that mention an identity term."""
    return df.filter((F.col(label) == 1) & (F.col("identity_term_count") > 0))
