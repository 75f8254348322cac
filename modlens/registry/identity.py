"""Identity-term queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import identity as idf
from modlens.functions import negation as ng
from modlens.functions import text as tx
from modlens.operators import identity as op
from modlens.operators.normalise import toxic_with_identity
from modlens.operators.term_index import held_terms
from modlens.registry.inputs import (
    CLEANED, SIX_LABELS, Query, cleaned, labels, quoted, read, sql_in, sql_words, with_labels,
)
from modlens.sources.tables import small_table

COUNT_COLUMNS = [f"{c}_mentions" for c in lx.IDENTITY_TERMS] + ["identity_term_count"]
# The default stop words, as the SQL lists them.
STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
    hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very s
    t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
    weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
    couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
""".split()


def identity_columns(spark, folder):
    """Counts per category, total, flag, mean context sentiment (the default, 0)."""
    out = op.identity_columns(cleaned(spark, folder))
    return out.select(
        "doc_id", *COUNT_COLUMNS, "has_identity_terms", "identity_context_sentiment"
    )


def identity_sentiment(spark, folder):
    """The mean context sentiment with the lexicon score."""
    out = op.identity_columns(cleaned(spark, folder, spread=True), sentiment=idf.lexicon_sentiment())
    return out.select("doc_id", F.round("identity_context_sentiment", 6).alias("sentiment"))


def mention_table(spark, folder):
    out = op.mention_table(cleaned(spark, folder), sentiment=idf.lexicon_sentiment())
    return out.withColumn("context_sentiment", F.round("context_sentiment", 6))


def nested_mentions(spark, folder):
    """The nested form, as one line per document."""
    nested = op.nested_mentions(cleaned(spark, folder))
    line = F.transform(
        F.map_entries("identity_mentions"),
        lambda e: F.concat_ws(
            "=", e["key"],
            F.array_join(F.transform(e["value"], lambda m: F.concat_ws(
                "@", m["term"], m["position"].cast("string"))), ","),
        ),
    )
    return nested.select("doc_id", F.array_join(F.sort_array(line), ";").alias("mentions"))


def term_statistics(spark, folder):
    out = op.term_statistics(cleaned(spark, folder), labels=labels(spark, folder))
    return out.withColumn("toxic_ratio", F.round("toxic_ratio", 6))


def term_statistics_words(spark, folder):
    out = op.term_statistics(cleaned(spark, folder), word_boundary=True, labels=labels(spark, folder))
    return out.withColumn("toxic_ratio", F.round("toxic_ratio", 6))


def phrase_term_pairs(spark, folder):
    return op.phrase_term_pairs(cleaned(spark, folder)).groupBy("doc_id", "term").agg(
        F.count("*").alias("phrases")
    )


def words_not_stopped(spark, folder):
    """Corpus words that are no stop word, where identity terms are never stop words."""
    terms = lx.distinct_terms(lx.IDENTITY_TERMS)
    stops = small_table(spark, [(w,) for w in ng.content_stop_words(ng.default_stop_words(), terms)], "word string")
    words = cleaned(spark, folder).select(F.explode(tx.words(F.lower("text"))).alias("word"))
    kept = words.join(F.broadcast(stops), "word", "left_anti")
    return kept.groupBy("word").agg(F.count("*").alias("n"))


def terms_in_use(spark, folder):
    """Distinct lexicon terms, lower-cased, with the number of texts that hold them as a word."""
    terms = op.lexicon_table(spark).select(F.lower("term").alias("term")).distinct()
    words = cleaned(spark, folder).select(
        F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("term")
    )
    counts = words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("texts"))
    return terms.join(counts, "term", "left").fillna({"texts": 0})


def toxic_identity_count(spark, folder):
    """Toxic comments with identity terms, per number of mentions."""
    counts = op.identity_columns(cleaned(spark, folder)).drop("text")
    hits = toxic_with_identity(with_labels(counts, spark, folder))
    return hits.groupBy("identity_term_count").agg(F.count("*").alias("n"))


# -- SQL -------------------------------------------------------------------------------------


def _alt(terms) -> str:
    return "|".join(sorted(terms))


def sql_mention_count(terms, text="text") -> str:
    return rf"len(regexp_extract_all(lower({text}), '\b(?:{_alt(terms)})\b'))"


SQL_COUNTS = ", ".join(
    f"{sql_mention_count(t)} AS {c}_mentions" for c, t in lx.IDENTITY_TERMS.items()
)
SQL_TOTAL = " + ".join(f"{c}_mentions" for c in lx.IDENTITY_TERMS)
IDENTITY = (
    f"ic AS (SELECT *, {SQL_COUNTS} FROM cleaned), "
    f"idn AS (SELECT *, {SQL_TOTAL} AS identity_term_count FROM ic)"
)

_pos = f"list_filter({sql_words('lower(context)')}, lambda w: w IN {sql_in(lx.POSITIVE_WORDS)})"
_neg = f"list_filter({sql_words('lower(context)')}, lambda w: w IN {sql_in(lx.NEGATIVE_WORDS)})"
SQL_SENTIMENT = f"(len({_pos}) - len({_neg})) / len({sql_words('context')})::DOUBLE"


def _sql_mentions() -> str:
    """CTE ``m``: one row per mention, by looking at every character position of a match.

    The text before each match is rebuilt from the gaps between the matches; the words before
    it are counted by cutting that prefix.
    """
    parts = []
    for c, terms in lx.IDENTITY_TERMS.items():
        pattern = rf"\b(?:{_alt(terms)})\b"
        parts.append(
            f"SELECT doc_id, text, '{c}' AS category,"
            f" unnest(regexp_extract_all(lower(text), '{pattern}')) AS term,"
            f" generate_subscripts(regexp_extract_all(lower(text), '{pattern}'), 1) AS k,"
            f" regexp_extract_all(lower(text), '{pattern}') AS found,"
            f" string_split_regex(lower(text), '{pattern}') AS gaps FROM cleaned"
        )
    words = sql_words("text")
    return (
        "f AS (" + " UNION ALL ".join(parts) + "), "
        "p AS (SELECT doc_id, text, category, term,"
        " CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g)))"
        " + coalesce(list_sum(list_transform(found[1:k-1], lambda t: length(t))), 0) AS INT)"
        " AS position FROM f), "
        f"w AS (SELECT *, {words} AS ws, len({sql_words('substr(text, 1, position)')}) AS ix FROM p), "
        "m AS (SELECT doc_id, category, term, position,"
        " array_to_string(ws[greatest(ix - 5, 0) + 1 : ix + 6], ' ') AS context FROM w), "
        f"ms AS (SELECT *, round({SQL_SENTIMENT}, 6) AS context_sentiment,"
        f" {SQL_SENTIMENT} AS raw_sentiment FROM m)"
    )


LABELLED = f"{CLEANED}, {SIX_LABELS}, labelled AS (SELECT * FROM cleaned JOIN six USING (doc_id))"


def _sql_term_stats(words: bool) -> str:
    rows = []
    for c, terms in lx.IDENTITY_TERMS.items():
        for t in terms:
            if words:
                n = rf"len(regexp_extract_all(lower(text), '\b{t}\b'))"
            else:
                n = f"(length(text) - length(replace(text, {quoted(t)}, ''))) // {len(t)}"
            rows.append(f"SELECT '{c}' AS category, '{t}' AS term, toxic, {n} AS n FROM labelled")
    return (
        f"WITH {LABELLED}, r AS (" + " UNION ALL ".join(rows) + "), s AS (SELECT category, term,"
        " CAST(sum(n) AS BIGINT) AS total_mentions,"
        " CAST(sum(CASE WHEN toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_mentions"
        " FROM r GROUP BY 1, 2) SELECT *, CASE WHEN total_mentions = 0 THEN 0"
        " ELSE round(toxic_mentions / total_mentions::DOUBLE, 6) END AS toxic_ratio FROM s"
    )


def benchmark_terms(spark, folder):
    """How often, and in how many documents, each longer word of the benchmark stands in the documents."""
    word = F.explode(tx.words(F.lower(F.col("text")))).alias("term")
    rows = read(spark, folder, "benchmark").select(word).filter(F.length("term") >= 5).distinct().collect()
    # A lexicon is a parameter, held by the driver; this one follows the table.
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = held_terms(docs, "text", [r["term"] for r in rows], ["doc_id"], counts=True)
    return found.groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))


_KEPT_STOPS = [w for w in STOP_WORDS if w not in lx.distinct_terms(lx.IDENTITY_TERMS)]
_TERM_LIST = ", ".join(f"({quoted(t)})" for t in lx.distinct_terms(lx.IDENTITY_TERMS))

QUERIES = {
    "identity_columns": Query(
        identity_columns,
        f"WITH {CLEANED}, {IDENTITY} SELECT doc_id, {', '.join(COUNT_COLUMNS)},"
        " identity_term_count > 0 AS has_identity_terms,"
        " 0::DOUBLE AS identity_context_sentiment FROM idn",
    ),
    "identity_sentiment": Query(
        identity_sentiment,
        f"WITH {CLEANED}, {_sql_mentions()} SELECT doc_id,"
        " round(coalesce(s, 0), 6) AS sentiment FROM cleaned LEFT JOIN"
        " (SELECT doc_id, avg(raw_sentiment) AS s FROM ms GROUP BY 1) USING (doc_id)",
    ),
    "mention_table": Query(
        mention_table,
        f"WITH {CLEANED}, {_sql_mentions()} SELECT doc_id, category, term, position, context,"
        " context_sentiment FROM ms",
    ),
    "nested_mentions": Query(
        nested_mentions,
        f"WITH {CLEANED}, {_sql_mentions()}, l AS (SELECT doc_id, category || '=' ||"
        " string_agg(term || '@' || position, ',' ORDER BY position) AS s FROM m GROUP BY doc_id, category)"
        " SELECT doc_id, coalesce(t, '') AS mentions FROM cleaned LEFT JOIN"
        " (SELECT doc_id, string_agg(s, ';' ORDER BY s) AS t FROM l GROUP BY 1) USING (doc_id)",
    ),
    "term_statistics": Query(term_statistics, _sql_term_stats(False)),
    "term_statistics_words": Query(term_statistics_words, _sql_term_stats(True)),
    "phrase_term_pairs": Query(
        phrase_term_pairs,
        f"WITH {CLEANED}, ph AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?]')) AS phrase"
        f" FROM cleaned), t AS (SELECT * FROM (VALUES {_TERM_LIST}) v(term))"
        " SELECT doc_id, term, count(*) AS phrases FROM ph JOIN t ON contains(phrase, term) GROUP BY 1, 2",
    ),
    "benchmark_terms": Query(
        benchmark_terms,
        f"WITH t AS (SELECT DISTINCT term FROM (SELECT unnest({sql_words('lower(text)')}) AS term FROM benchmark)"
        " WHERE length(term) >= 5), p AS (SELECT term, text FROM documents JOIN t ON contains(text, term))"
        " SELECT term, count(*) AS texts,"
        " CAST(sum((length(text) - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS n FROM p GROUP BY 1",
    ),
    "words_not_stopped": Query(
        words_not_stopped,
        f"WITH {CLEANED}, w AS (SELECT unnest({sql_words('lower(text)')}) AS word FROM cleaned)"
        f" SELECT word, count(*) AS n FROM w WHERE word NOT IN {sql_in(_KEPT_STOPS)} GROUP BY 1",
    ),
    "terms_in_use": Query(
        terms_in_use,
        f"WITH {CLEANED}, w AS (SELECT DISTINCT doc_id, unnest({sql_words('lower(text)')}) AS term"
        f" FROM cleaned), t AS (SELECT * FROM (VALUES {_TERM_LIST}) v(term))"
        " SELECT term, count(doc_id) AS texts FROM t LEFT JOIN w USING (term) GROUP BY 1",
    ),
    "toxic_identity_count": Query(
        toxic_identity_count,
        f"WITH {LABELLED}, ic AS (SELECT *, {SQL_COUNTS} FROM labelled),"
        f" idn AS (SELECT *, {SQL_TOTAL} AS identity_term_count FROM ic)"
        " SELECT identity_term_count, count(*) AS n FROM idn"
        " WHERE toxic = 1 AND identity_term_count > 0 GROUP BY 1",
    ),
}
