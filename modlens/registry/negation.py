"""Negation and polarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import negation as ng
from modlens.operators import identity as op
from modlens.operators.normalise import clean_comments, normalise, toxic_with_identity
from modlens.operators.ranking import top_k
from modlens.registry.identity import LABELLED, SQL_COUNTS, SQL_TOTAL, STOP_WORDS
from modlens.registry.inputs import (
    CLEANED, SQL_SPACE, Query, cleaned, comments, quoted, sql_in, sql_tokens, with_labels,
)

TERMS = lx.distinct_terms(lx.IDENTITY_TERMS)


def mark_negation(spark, folder):
    marked = ng.mark_negation(F.col("text"), TERMS)
    return cleaned(spark, folder).select("doc_id", marked.alias("normalized_text"))


def mark_negation_lower(spark, folder):
    """Ordinary tokens lower-cased; terminators, negations and identity terms keep their case."""
    marked = ng.mark_negation(F.col("text"), TERMS, STOP_WORDS, preserve_case=False)
    return cleaned(spark, folder).select("doc_id", marked.alias("normalized_text"))


def polarity(spark, folder):
    df = cleaned(spark, folder, spread=True).select("doc_id", ng.polarity(F.col("text"), TERMS).alias("p"))
    return df.select("doc_id", "p.*")


def normalise_table(spark, folder):
    """Normalised text with the polarity columns."""
    return normalise(cleaned(spark, folder, spread=True)).drop("text")


def polarity_by_class(spark, folder):
    """Sums of the polarity columns of toxic and other comments."""
    polar = cleaned(spark, folder).select("doc_id", ng.polarity(F.col("text"), TERMS).alias("p"))
    df = with_labels(polar, spark, folder)
    sums = [F.sum(f"p.{c}").alias(c) for c in ng.POLARITY_COLUMNS]
    return df.groupBy("toxic").agg(*sums)


def toxic_identity_sample(spark, folder):
    """The first five toxic comments with identity terms and their polarity columns."""
    counts = op.identity_columns(cleaned(spark, folder, spread=True)).select("doc_id", "identity_term_count")
    first = top_k(toxic_with_identity(with_labels(counts, spark, folder)), [F.col("doc_id")], 5)
    # Five rows, which meet their texts before these are cleaned.
    texts = clean_comments(comments(spark, folder).join(F.broadcast(first), "doc_id"))
    out = normalise(texts)
    return out.select("doc_id", "identity_term_count", "normalized_text", *ng.POLARITY_COLUMNS)


# -- SQL -------------------------------------------------------------------------------------

_closing = lx.SCOPE_TERMINATORS
_opening = [
    "not", "no", "never", "none", "neither", "nowhere", "nobody", "nothing", "n't", "cannot",
    "can't", "won't", "wouldn't", "shouldn't", "couldn't", "don't", "doesn't", "isn't", "aren't", "ain't",
    "cant", "wont", "wouldnt", "shouldnt", "couldnt", "dont", "doesnt", "isnt", "arent", "aint",
]
_identity = [t for t in TERMS if " " not in t]
_unmarked = lx.NON_NEGATABLE + [w for w in STOP_WORDS if w not in TERMS]


def _sql_marked(lower: bool, source: str = "cleaned") -> str:
    """CTEs ending in ``marked``: explode tokens, cut scopes, number the ordinary tokens."""
    plain = "lower(tok)" if lower else "tok"
    return (
        f"tk AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok,"
        f" generate_subscripts({sql_tokens('text')}, 1) AS pos FROM {source}), "
        f"kd AS (SELECT *, CASE WHEN lower(tok) IN {sql_in(_closing)} THEN 'T'"
        f" WHEN lower(tok) IN {sql_in(_opening)} THEN 'N'"
        f" WHEN lower(tok) IN {sql_in(_identity)} THEN 'I' ELSE 'O' END AS kind,"
        f" lower(tok) NOT IN {sql_in(_unmarked)} AS may FROM tk), "
        "sg AS (SELECT *, sum(CASE WHEN kind IN ('T', 'N') THEN 1 ELSE 0 END)"
        " OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM kd), "
        "nr AS (SELECT *, max(CASE WHEN kind = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg) AS neg,"
        " sum(CASE WHEN kind = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS k"
        " FROM sg), "
        "er AS (SELECT *, max(CASE WHEN kind = 'O' AND k <= 2 AND may THEN 1 ELSE 0 END)"
        " OVER (PARTITION BY doc_id, seg) AS early FROM nr), "
        "mk AS (SELECT doc_id, pos, CASE WHEN kind <> 'O' THEN tok"
        f" WHEN neg = 1 AND may AND (k <= 2 OR (k = 3 AND early = 0)) THEN 'NOT_' || {plain}"
        f" ELSE {plain} END AS tok FROM er), "
        f"marked AS (SELECT doc_id, coalesce(t, '') AS normalized_text FROM {source} LEFT JOIN"
        " (SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS t FROM mk GROUP BY 1) USING (doc_id))"
    )


def _sql_polarity(source: str = "cleaned") -> str:
    """CTEs ending in ``polar``: phrases joined with the terms they hold."""
    neg = "|".join(_opening)
    terms = ", ".join(f"({quoted(t)})" for t in TERMS)
    return (
        f"ph0 AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]')) AS phrase,"
        f" generate_subscripts(string_split_regex(text, '[.!?]'), 1) AS pn FROM {source}), "
        rf"ph AS (SELECT *, CAST(regexp_matches(lower(phrase), '\b(?:{neg.replace(chr(39), chr(39) * 2)})\b')"
        rf" AS INT) AS negated FROM ph0 WHERE regexp_matches(phrase, '[^{SQL_SPACE}]')), "
        f"tm AS (SELECT * FROM (VALUES {terms}) v(term)), "
        f"pt AS (SELECT *, list_transform({sql_tokens('phrase')}, lambda w: lower(w)) AS ws FROM ph"
        " JOIN tm ON contains(lower(phrase), term)), "
        "px AS (SELECT *, list_position(list_transform(ws, lambda w: contains(w, term)), true) AS ix FROM pt), "
        "pc AS (SELECT *, CASE WHEN coalesce(ix, 0) > 0 THEN ws[greatest(ix - 5, 1) : ix + 5] ELSE ws END AS ctx"
        " FROM px WHERE coalesce(ix, 0) > 0 OR contains(term, ' ')), "
        "hits AS (SELECT doc_id, CAST(sum(negated) AS INT) AS identity_in_negation,"
        f" CAST(count(*) FILTER (len(list_filter(ctx, lambda w: w IN {sql_in(lx.POSITIVE_WORDS)})) > 0) AS INT)"
        " AS identity_positive_context,"
        f" CAST(count(*) FILTER (len(list_filter(ctx, lambda w: w IN {sql_in(lx.NEGATIVE_WORDS)})) > 0) AS INT)"
        " AS identity_negative_context FROM pc GROUP BY 1), "
        "nc AS (SELECT doc_id, CAST(sum(negated) AS INT) AS negation_count FROM ph GROUP BY 1), "
        "polar AS (SELECT doc_id, coalesce(negation_count, 0) AS negation_count,"
        " coalesce(identity_in_negation, 0) AS identity_in_negation,"
        " coalesce(identity_positive_context, 0) AS identity_positive_context,"
        f" coalesce(identity_negative_context, 0) AS identity_negative_context FROM {source}"
        " LEFT JOIN nc USING (doc_id) LEFT JOIN hits USING (doc_id))"
    )


_cols = ", ".join(ng.POLARITY_COLUMNS)
_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ng.POLARITY_COLUMNS)

QUERIES = {
    "mark_negation": Query(
        mark_negation,
        f"WITH {CLEANED}, {_sql_marked(False)} SELECT doc_id, normalized_text FROM marked",
    ),
    "mark_negation_lower": Query(
        mark_negation_lower,
        f"WITH {CLEANED}, {_sql_marked(True)} SELECT doc_id, normalized_text FROM marked",
    ),
    "polarity": Query(
        polarity, f"WITH {CLEANED}, {_sql_polarity()} SELECT doc_id, {_cols} FROM polar"
    ),
    "normalise_table": Query(
        normalise_table,
        f"WITH {CLEANED}, {_sql_marked(False)}, {_sql_polarity()}"
        f" SELECT doc_id, normalized_text, {_cols} FROM marked JOIN polar USING (doc_id)",
    ),
    "polarity_by_class": Query(
        polarity_by_class,
        f"WITH {LABELLED}, {_sql_polarity('labelled')}"
        f" SELECT toxic, {_sums} FROM polar JOIN six USING (doc_id) GROUP BY 1",
    ),
    "toxic_identity_sample": Query(
        toxic_identity_sample,
        f"WITH {LABELLED}, ic AS (SELECT *, {SQL_COUNTS} FROM labelled),"
        f" idn AS (SELECT *, {SQL_TOTAL} AS identity_term_count FROM ic),"
        " five AS (SELECT * FROM idn WHERE toxic = 1 AND identity_term_count > 0 ORDER BY doc_id LIMIT 5),"
        f" {_sql_marked(False, 'five')}, {_sql_polarity('five')}"
        f" SELECT doc_id, identity_term_count, normalized_text, {_cols}"
        " FROM five JOIN marked USING (doc_id) JOIN polar USING (doc_id)",
    ),
}
