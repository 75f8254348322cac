"""Corpus profile: class balance, vocabulary, lengths, sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions import text as tx
from modlens.sources.tables import small_table


def class_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label: positives, rows and percentage of positives. One pass over the table."""
    one = df.agg(
        F.count("*").alias("total"), *[F.sum(F.col(c)).cast("bigint").alias(c) for c in labels]
    )
    return (
        one.unpivot(["total"], list(labels), "label_name", "positives")
        .withColumn("percentage", F.col("positives") / F.col("total") * 100)
        .select("label_name", "positives", "total", "percentage")
    )


def value_counts(
    df: DataFrame, column: str, normalize: bool = False, categories: Sequence[str] | None = None
) -> DataFrame:
    """Distinct values with their counts (and shares); named categories without rows give 0."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if categories is not None:
        names = small_table(df.sparkSession, [(c,) for c in categories], f"{column} string")
        counts = names.join(counts, column, "left").fillna({"n": 0})
    if normalize:
        every = Window.partitionBy()  # one row per value
        counts = counts.withColumn("share", F.col("n") / F.sum("n").over(every))
    return counts


def word_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus words with their counts, summed per partition before the shuffle."""
    return (
        df.select(F.explode(tx.corpus_words(F.col(text_col))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def coverage(frequencies: DataFrame, share: float = 0.9, mode: str = "reference") -> DataFrame:
    """Vocabulary size and the number of most frequent words within a share of the corpus.

    ``reference`` compares the running count with the share of the sum of all running counts;
    ``true`` compares it with the share of the total count. Words are first grouped by their
    count: the running sum goes over distinct counts only, of which there are at most
    sqrt(2 x corpus words).
    """
    hist = frequencies.groupBy("n").agg(F.count("*").alias("m"))
    c, m, base = (F.col(x).cast("decimal(38,0)") for x in ("n", "m", "base"))
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    runs = hist.withColumn(
        "base", F.coalesce(F.sum((c * m).cast("decimal(38,0)")).over(w), F.lit(0)).cast("decimal(38,0)")
    )
    # The same few rows as above, so one window more.
    if mode == "reference":
        # words with base + c, base + 2c, ... base + mc
        whole = F.sum((m * base).cast("double") + (c * m).cast("double") * (m + 1).cast("double") / 2)
    else:
        whole = F.sum((c * m).cast("double"))
    limit = whole.over(Window.partitionBy()) * share
    inside = F.floor((F.col("limit") - base.cast("double")) / c.cast("double"))
    return runs.withColumn("limit", limit).agg(
        F.sum("m").alias("vocabulary"),
        F.sum(F.least(F.col("m"), F.greatest(F.lit(0), inside))).cast("bigint").alias("covered"),
    )


def word_and_length_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of corpus words (word, NULL, n) and of text lengths (NULL, length, n) in one pass."""
    text = F.col(text_col)
    length = tx.word_total(text)
    kind = "struct<word:string,length:bigint>"
    words = F.transform(
        tx.corpus_words(F.coalesce(text, F.lit(""))),
        lambda w: F.struct(w.alias("word"), F.lit(None).cast("bigint").alias("length")).cast(kind),
    )
    one = F.array(F.struct(F.lit(None).cast("string").alias("word"), length.cast("bigint").alias("length")).cast(kind))
    rows = df.select(F.explode(F.concat(words, one)).alias("r")).select("r.*")
    return rows.groupBy("word", "length").agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Number of texts per word count."""
    return (
        df.select(tx.word_total(F.col(text_col)).alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("n"))
    )


def length_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean, median and 95th percentile of the word count, and the latter cut to an integer.

    Quantiles interpolate and are exact; they run over the histogram of lengths.
    """
    return histogram_stats(length_histogram(df, text_col))


def histogram_stats(histogram: DataFrame) -> DataFrame:
    """The same from rows (length, n)."""
    hist = histogram.filter(F.col("length").isNotNull())
    return hist.agg(
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_length"),
        F.percentile("length", F.lit(0.5), F.col("n")).alias("median_length"),
        F.percentile("length", F.lit(0.95), F.col("n")).alias("p95_length"),
    ).withColumn("maxlen", F.col("p95_length").cast("int"))


def sizing(coverage_df: DataFrame, lengths_df: DataFrame) -> DataFrame:
    """Vocabulary limit, sequence length and embedding width from the two one-row profiles."""
    vocab = F.floor(F.col("covered") * 1.2).cast("bigint")
    return (
        coverage_df.select(
            F.least(vocab, F.lit(200000)).alias("max_features"),
            lengths_df.select("maxlen").scalar().alias("maxlen"),
        )
        .withColumn(
            "embed_size",
            F.when(F.col("max_features") < 50000, 100)
            .when(F.col("max_features") < 100000, 200)
            .otherwise(300),
        )
    )
