"""Identity-term columns, mention table and term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import identity as idf
from modlens.functions import text as tx
from modlens.functions.arrays import let, string_array, with_fields
from modlens.functions.identity import Lexicon, Sentiment, no_sentiment
from modlens.operators.term_index import categories, held_terms
from modlens.sources.tables import small_table

# Terms from which on a lexicon is searched through an index; below, one pass per term is cheaper.
INDEX_FROM = 200


def lexicon_table(spark: SparkSession, lexicon: Lexicon = lx.IDENTITY_TERMS) -> DataFrame:
    """The lexicon as rows (category, term)."""
    rows = [(c, t) for c, terms in lexicon.items() for t in terms]
    return small_table(spark, rows, "category string, term string")


def identity_columns(
    df: DataFrame,
    text_col: str = "text",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    sentiment: Sentiment | None = None,
) -> DataFrame:
    """Mention counts per category and in total, a flag, and the mean context sentiment.

    A term listed in two categories counts in both. Without a sentiment function the mean is 0
    and no context is built.
    """
    text = F.col(text_col)

    def counted(words: Column) -> Column:
        per = idf.mention_counts(text, words, lexicon)
        total = F.lit(0)
        for n in per.values():
            total = total + n
        return F.struct(
            *[n.alias(f"{c}_mentions") for c, n in per.items()],
            total.alias("identity_term_count"),
        )

    def mean_sentiment() -> Column:
        if sentiment is None:
            return F.lit(0.0)
        scores = idf.mentions(text, lexicon, sentiment=sentiment)["context_sentiment"]
        return let(
            scores,
            lambda s: F.coalesce(
                F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), F.size(s)), F.lit(0.0)
            ),
        )

    counts = let(idf.listed_words(text, lx.distinct_terms(lexicon)), counted)
    out = with_fields(df, {"_idn": counts, "identity_context_sentiment": mean_sentiment()})
    return (
        out.select("*", "_idn.*")
        .drop("_idn")
        .withColumn("has_identity_terms", F.col("identity_term_count") > 0)
    )


def mention_table(
    df: DataFrame,
    text_col: str = "text",
    key: str = "doc_id",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    window: int = 5,
    sentiment: Sentiment = no_sentiment,
) -> DataFrame:
    """One row per mention: key, category, term, position, context, context_sentiment."""
    text = F.col(text_col)
    return df.select(key, F.inline(idf.mentions(text, lexicon, window, sentiment)))


def nested_mentions(
    df: DataFrame,
    text_col: str = "text",
    key: str = "doc_id",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    window: int = 5,
    sentiment: Sentiment = no_sentiment,
) -> DataFrame:
    """Per document a map from category to its mentions; categories without one are left out."""
    text = F.col(text_col)
    every = idf.mentions(text, lexicon, window, sentiment)

    def entry(found: Column, category: str) -> Column:
        own = F.filter(found, lambda m: m["category"] == category)
        return F.struct(F.lit(category).alias("category"), own.alias("found"))

    def grouped(found: Column) -> Column:
        entries = F.array(*[entry(found, c) for c in lexicon])
        return F.map_from_entries(F.filter(entries, lambda e: F.size(e["found"]) > 0))

    return df.select(key, let(every, grouped).alias("identity_mentions"))


def term_statistics(
    df: DataFrame,
    text_col: str = "text",
    label: str = "toxic",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    word_boundary: bool = False,
    labels: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Per (category, term): mentions, mentions in positive rows, and their ratio.

    With a table of ``labels`` the label is joined by key to the counts of each text, so that the
    texts stay where they are; texts without a label are left out.

    Counts are case-sensitive substrings, so "man" counts in "woman"; ``word_boundary`` counts
    whole words of any case instead. One pass: the text, which may come out of a costly chain, and
    its counts are each made once per row, only the terms a text holds are exploded, and counts
    are summed per partition before the shuffle of at most one row per term.
    """
    text = F.col("_text")
    own = key if labels is not None else label
    if word_boundary:
        one = F.lit(1).cast("bigint").alias("n")
        every = idf.mentions(text, lexicon)
        found = F.transform(
            every, lambda m: F.struct(m["category"].alias("category"), m["term"].alias("term"), one)
        )
    else:
        found = idf.term_counts(text, lexicon)
    df = with_fields(df.select(own, F.col(text_col).alias("_text")), {"_text": text})
    if not word_boundary and sum(map(len, lexicon.values())) > INDEX_FROM:
        # A row per term that a text holds, with the terms found by their q-grams.
        pairs = categories(held_terms(df, "_text", {t for ts in lexicon.values() for t in ts}, [own], counts=True), lexicon)
        pairs = pairs.select(own, F.struct("category", "term", "n").alias("m"))
    else:
        df = with_fields(df.select(own, "_text"), {"_found": found})
        pairs = df.select(own, F.explode("_found").alias("m"))
    if labels is not None:
        # Texts without a hit need no label.
        pairs = pairs.join(labels.select(key, label), key)
    counted = (
        pairs.select((F.col(label) == 1).alias("_pos"), "m")
        .groupBy("m.category", "m.term")
        .agg(
            F.sum("m.n").alias("total_mentions"),
            F.sum(F.when(F.col("_pos"), F.col("m.n")).otherwise(0)).alias("toxic_mentions"),
        )
    )
    terms = lexicon_table(df.sparkSession, lexicon)
    zero = {"total_mentions": 0, "toxic_mentions": 0}
    return (
        # at most one row per term of the lexicon
        terms.join(counted, ["category", "term"], "left")
        .fillna(zero)
        .withColumn(
            "toxic_ratio",
            F.coalesce(F.try_divide(F.col("toxic_mentions"), F.col("total_mentions")), F.lit(0.0)),
        )
    )


def phrase_term_pairs(
    df: DataFrame,
    text_col: str = "text",
    key: str = "doc_id",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
) -> DataFrame:
    """Which phrase of which document holds which term as a substring.

    A large lexicon is searched through the q-grams of its terms, a small one term by term.
    """
    listed = lx.distinct_terms(lexicon)
    phrase = df.select(
        key, F.posexplode(tx.phrases(F.lower(F.col(text_col)))).alias("phrase_no", "phrase")
    )
    if len(listed) > INDEX_FROM:
        return held_terms(phrase, "phrase", listed, [key, "phrase_no"])
    held = F.filter(string_array(listed), lambda t: F.contains(F.col("phrase"), t))
    return phrase.select(key, "phrase_no", F.explode(held).alias("term"))
