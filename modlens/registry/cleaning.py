"""Cleaning and splitting queries."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import text as tx
from modlens.operators.normalise import clean_comments
from modlens.registry.inputs import (
    CLEANED, COMMENTS, EMAIL, NO_EMAILS, NO_URLS, PRINTABLE, SQL_SPACE, Query, cleaned, comments,
    read, sql_corpus_words, sql_expanded, sql_sentences, sql_tokens, sql_words,
)

def url_flag(spark, folder):
    """Rows with a link, flag kept."""
    return comments(spark, folder).withColumn("url_in_text", tx.has_url(F.col("text"))).filter("url_in_text")


def url_class_counts(spark, folder):
    """Rows with and without a link mark, on page addresses."""
    pages = read(spark, folder, "pages").select(tx.has_url(F.col("url")).alias("url_in_text"))
    return pages.groupBy("url_in_text").agg(F.count("*").alias("n"))


def page_address_removal(spark, folder):
    """Page address inside a sentence, then removed."""
    line = F.concat(F.lit("page "), F.col("url"), F.lit(" is here"))
    pages = read(spark, folder, "pages").select("page_id", line.alias("line"))
    return pages.select("page_id", tx.remove_urls(F.col("line")).alias("line"))


def remove_urls(spark, folder):
    return comments(spark, folder).select("doc_id", tx.remove_urls(F.col("text")).alias("text"))


def email_flag(spark, folder):
    """Flag for an address at the start of a comment; each line is added as a comment of its own."""
    whole = comments(spark, folder).select("doc_id", F.lit(0).alias("ln"), "text")
    lines = comments(spark, folder).select("doc_id", F.posexplode(F.split("text", "[\n ]")).alias("ln", "text"))
    rows = whole.unionByName(lines.withColumn("ln", F.col("ln") + 1))
    flags = rows.select("doc_id", "ln", tx.starts_with_email(F.col("text")).alias("email_in_text"))
    return flags.groupBy("doc_id").agg(
        F.max(F.when(F.col("ln") == 0, F.col("email_in_text"))).alias("email_in_text"),
        F.count_if("email_in_text").alias("starts"),
    )


def remove_emails(spark, folder):
    return comments(spark, folder).select("doc_id", tx.remove_emails(F.col("text")).alias("text"))


def keep_printable(spark, folder):
    return comments(spark, folder).select("doc_id", tx.keep_printable(F.col("text")).alias("text"))


def expand_shorthand(spark, folder):
    """The dictionary passes one by one, on printable text."""
    df = comments(spark, folder).withColumn("text", tx.keep_printable(F.col("text")))
    cols = [tx.expand_shorthand(F.col("text"), p).alias(f"pass_{i + 1}")
            for i, p in enumerate(lx.SUBSTITUTION_PASSES)]
    return df.select("doc_id", *cols)


def clean_all(spark, folder):
    return clean_comments(comments(spark, folder))


def clean_turns(spark, folder):
    """The cleaning chain on conversation turns, keyed by two columns."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "text")
    return clean_comments(turns)


def word_split(spark, folder):
    return comments(spark, folder).select(
        "doc_id",
        tx.word_total(F.col("text")).cast("bigint").alias("n_words"),
        F.size(tx.words(F.lower(F.col("text")))).cast("bigint").alias("n_lower_words"),
        F.get(tx.words(F.lower(F.col("text"))), F.lit(0)).alias("first_word"),
    )


def phrase_split(spark, folder):
    return cleaned(spark, folder).select(
        "doc_id", F.explode(tx.phrases(F.col("text"))).alias("phrase")
    )


def tokenise(spark, folder):
    toks = cleaned(spark, folder).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return toks.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), tx.joined(F.col("t")).alias("tokens")
    )


def sentence_split(spark, folder):
    return cleaned(spark, folder, spread=True).select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))


def corpus_words(spark, folder):
    return comments(spark, folder).select("doc_id", F.explode(tx.corpus_words(F.col("text"))).alias("word"))


def character_ratios(spark, folder):
    return cleaned(spark, folder).select(
        "doc_id",
        F.round(tx.char_ratio(F.col("text"), "A-Z"), 6).alias("uppercase_ratio"),
        F.round(tx.char_set_ratio(F.col("text"), string.punctuation), 6).alias("punctuation_ratio"),
        tx.count_matches(F.col("text"), r"[A-Z]\w+").cast("bigint").alias("capitalised"),
    )


def null_guard(spark, folder):
    """Blank texts flagged and counts given as 0, on lines of the documents."""
    lines = comments(spark, folder).select("doc_id", F.explode(F.split(F.col("text"), "\n")).alias("line"))
    # A NULL line more for each document.
    df = lines.unionByName(comments(spark, folder).select("doc_id", F.lit(None).cast("string").alias("line")))
    return df.groupBy("doc_id").agg(
        F.count_if(tx.is_blank(F.col("line"))).alias("blank"),
        F.sum(F.coalesce(tx.word_total(F.col("line")), F.lit(0))).cast("bigint").alias("n_words"),
    )


def _from(cte: str, body: str) -> str:
    return f"WITH {cte} {body}"


QUERIES = {
    "url_flag": Query(
        url_flag,
        _from(COMMENTS, "SELECT doc_id, text, true AS url_in_text FROM raw WHERE contains(text, 'http')"),
    ),
    "url_class_counts": Query(
        url_class_counts,
        "SELECT contains(url, 'http') AS url_in_text, count(*) AS n FROM pages GROUP BY 1",
    ),
    "page_address_removal": Query(
        page_address_removal,
        f"SELECT page_id, {NO_URLS.replace('(text,', '(text,')} AS line"
        " FROM (SELECT page_id, 'page ' || url || ' is here' AS text FROM pages)",
    ),
    "remove_urls": Query(remove_urls, _from(COMMENTS, f"SELECT doc_id, {NO_URLS} AS text FROM raw")),
    "email_flag": Query(
        email_flag,
        _from(
            COMMENTS,
            rf"SELECT doc_id, regexp_matches(text, '\A{EMAIL}') AS email_in_text,"
            rf" CAST(regexp_matches(text, '\A{EMAIL}') AS BIGINT) + len(list_filter("
            rf"string_split_regex(text, '[\n ]'), lambda s: regexp_matches(s, '\A{EMAIL}'))) AS starts FROM raw",
        ),
    ),
    "remove_emails": Query(
        remove_emails, _from(COMMENTS, f"SELECT doc_id, {NO_EMAILS} AS text FROM raw")
    ),
    "keep_printable": Query(
        keep_printable, _from(COMMENTS, f"SELECT doc_id, {PRINTABLE} AS text FROM raw")
    ),
    "expand_shorthand": Query(
        expand_shorthand,
        _from(
            COMMENTS + f", p AS (SELECT doc_id, {PRINTABLE} AS text FROM raw)",
            "SELECT doc_id, "
            + ", ".join(
                f"{sql_expanded('text', e)} AS pass_{i + 1}"
                for i, e in enumerate(lx.SUBSTITUTION_PASSES)
            )
            + " FROM p",
        ),
    ),
    "clean_comments": Query(clean_all, _from(CLEANED, "SELECT doc_id, text FROM cleaned")),
    "clean_turns": Query(
        clean_turns,
        "WITH "
        + ", ".join(
            [
                f"c1 AS (SELECT conv_id, turn, {NO_URLS} AS text FROM conversations)",
                f"c2 AS (SELECT conv_id, turn, {NO_EMAILS} AS text FROM c1)",
                f"c3 AS (SELECT conv_id, turn, {PRINTABLE} AS text FROM c2)",
                *[
                    f"c{i + 4} AS (SELECT conv_id, turn, {sql_expanded('text', p)} AS text FROM c{i + 3})"
                    for i, p in enumerate(lx.SUBSTITUTION_PASSES)
                ],
            ]
        )
        + " SELECT conv_id, turn, text FROM c6",
    ),
    "word_split": Query(
        word_split,
        _from(
            COMMENTS,
            f"SELECT doc_id, len({sql_words('text')}) AS n_words,"
            f" len({sql_words('lower(text)')}) AS n_lower_words,"
            f" {sql_words('lower(text)')}[1] AS first_word FROM raw",
        ),
    ),
    "phrase_split": Query(
        phrase_split,
        _from(
            CLEANED,
            "SELECT doc_id, phrase FROM (SELECT doc_id,"
            " unnest(string_split_regex(text, '[.!?]')) AS phrase FROM cleaned)"
            f" WHERE regexp_matches(phrase, '[^{SQL_SPACE}]')",
        ),
    ),
    "tokenise": Query(
        tokenise,
        _from(
            CLEANED,
            f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens"
            f" FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM cleaned)",
        ),
    ),
    "sentence_split": Query(
        sentence_split,
        _from(CLEANED, f"SELECT doc_id, unnest({sql_sentences('text')}) AS sentence FROM cleaned"),
    ),
    "corpus_words": Query(
        corpus_words,
        _from(COMMENTS, f"SELECT doc_id, unnest({sql_corpus_words('text')}) AS word FROM raw"),
    ),
    "character_ratios": Query(
        character_ratios,
        _from(
            CLEANED,
            "SELECT doc_id,"
            " round(len(regexp_extract_all(text, '[A-Z]')) / length(text)::DOUBLE, 6) AS uppercase_ratio,"
            r" round(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) / length(text)::DOUBLE, 6)"
            " AS punctuation_ratio,"
            r" len(regexp_extract_all(text, '[A-Z]\w+')) AS capitalised FROM cleaned",
        ),
    ),
    "null_guard": Query(
        null_guard,
        _from(
            COMMENTS
            + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM raw)"
            ", n AS (SELECT * FROM l UNION ALL SELECT doc_id, NULL FROM raw)",
            "SELECT doc_id, count(*) FILTER (line IS NULL OR"
            f" NOT regexp_matches(line, '[^{SQL_SPACE}]')) AS blank,"
            f" CAST(sum(coalesce(len({sql_words('line')}), 0)) AS BIGINT) AS n_words FROM n GROUP BY 1",
        ),
    ),
}
