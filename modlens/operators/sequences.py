"""Word ids by frequency rank, and padded id sequences."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.functions import text as tx
from modlens.functions.arrays import let, literal
from modlens.operators.ranking import most_frequent


def word_index(
    df: DataFrame, num_words: int, text_col: str = "text", key: str | Sequence[str] = "doc_id",
    ties: str = "first_seen",
) -> DataFrame:
    """The ``num_words - 1`` most frequent words with their rank, 1 for the most frequent.

    Equal counts rank by first appearance (smallest key, then place in the text) or, with
    ``ties="word"``, by the word. The key may be of any type that can be ordered, or several
    columns. Only the rows kept are ranked in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    exploded = F.posexplode(tx.corpus_words(F.col(text_col))).alias("_ix", "word")
    measures, order = [F.count("*").alias("n")], []
    if ties == "first_seen" and len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType):
        # One number for (key, place) keeps the aggregate hash-based and in one pass.
        place = F.col(keys[0]).cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)")
        words = df.select(place.alias("_at"), exploded)
        measures.append(F.min((F.col("_at") + F.col("_ix")).cast("decimal(38,0)")).alias("_first"))
        order.append(F.col("_first").asc())
    elif ties == "first_seen":
        words = df.select(*keys, exploded)
        measures.append(F.min(F.struct(*keys, "_ix")).alias("_first"))
        order.append(F.col("_first").asc())
    else:
        words = df.select(exploded)
    counts = words.groupBy("word").agg(*measures)
    order.append(F.col("word").asc())
    kept = most_frequent(counts, "n", order, max(num_words - 1, 0))
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), *order))
    return kept.select("word", rank.alias("word_id"))


def word_lookup(ids: dict[str, int]) -> Column:
    """The ids as a constant array of small maps, one for each value of a hash of the word."""
    size = max(1, len(ids))
    slots: list[dict[str, int]] = [{} for _ in range(size)]
    for word, n in ids.items():
        slots[_slot(word, size)][word] = n
    return literal(slots, "array<map<string,int>>")


def _slot(word: str, size: int) -> int:
    # The same numbers as F.crc32 gives.
    return zlib.crc32(word.encode()) % size


class SequenceEncoder:
    """Turns texts into id sequences of one length: the last ``maxlen`` known words, 0 before."""

    def __init__(self, max_features: int, text_col: str = "text",
                 key: str | Sequence[str] = "doc_id", ties: str = "first_seen"):
        self.max_features = max_features
        self.text_col = text_col
        self.key = key
        self.ties = ties
        self.maxlen: int | None = None
        self.ids: dict[str, int] | None = None

    def fit(self, df: DataFrame, maxlen: int) -> "SequenceEncoder":
        """Learn the word ids of a training table; the driver holds ``max_features`` words at most."""
        self.maxlen = maxlen
        index = word_index(df, self.max_features, self.text_col, self.key, self.ties)
        self.ids = {r["word"]: r["word_id"] for r in index.collect()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Key and ``sequence`` for every row; unknown words are left out.

        Words are looked up where the text is; nothing is exploded or shuffled.
        """
        if self.ids is None or self.maxlen is None:
            raise ValueError("fit the encoder on training data first")
        size = max(1, len(self.ids))
        slots = word_lookup(self.ids)

        def known(word: Column) -> Column:
            slot = F.get(slots, (F.crc32(word.cast("binary")) % size).cast("int"))
            return F.try_element_at(slot, word)

        words = tx.corpus_words(F.coalesce(F.col(self.text_col), F.lit("")))
        found = F.filter(F.transform(words, known), lambda n: n.isNotNull())

        def padded(ids: Column) -> Column:
            last = F.slice(ids, F.greatest(F.size(ids) - self.maxlen, F.lit(0)) + 1, F.lit(self.maxlen))
            pad = F.array_repeat(F.lit(0), F.greatest(F.lit(self.maxlen) - F.size(ids), F.lit(0)))
            return F.concat(pad, last)

        keys = [self.key] if isinstance(self.key, str) else list(self.key)
        return df.select(*keys, let(found, padded).alias("sequence"))

    def fit_transform(self, df: DataFrame, maxlen: int) -> DataFrame:
        """Fit on a table and encode it."""
        return self.fit(df, maxlen).transform(df)
