"""Feature queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import features as ft
from modlens.functions import text as tx
from modlens.functions.arrays import let
from modlens.operators.normalise import clean_comments
from modlens.operators.ranking import first_per_class
from modlens.plans.engineered import engineered_features
from modlens.plans.manual_forest import feature_table
from modlens.registry.identity import (
    IDENTITY, LABELLED,
)
from modlens.registry.inputs import (
    CLEANED, Query, cleaned, comments, documents, quoted, read, sql_in, sql_sentences, sql_tokens,
    with_labels,
)
from modlens.registry.negation import _sql_marked, _sql_polarity
from modlens.registry.tfidf import FEATURES, TFIDF
from modlens.sources.taggers import tag_texts

def _rounded(df, names=None):
    names = names or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in names})


def aggression_by_class(spark, folder):
    """Documents and mean share of aggressive words, toxic against other; given texts, cleaned."""
    docs = clean_comments(documents(spark, folder))
    ratios = docs.select(
        "doc_id",
        let(
            tx.tokens(F.lower("text")),
            lambda t: ft.ratio(tx.count_in(t, lx.AGGRESSIVE_WORDS), F.size(t)),
        ).alias("ratio"),
    )
    joined = ratios.join(read(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    return joined.groupBy("toxic").agg(
        F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("aggressive_word_ratio")
    )


def linguistic_features(spark, folder):
    return _rounded(ft.linguistic_features(cleaned(spark, folder)).drop("text"))


def bias_patterns(spark, folder):
    terms = [t for ts in lx.IDENTITY_TERMS.values() for t in ts]
    return cleaned(spark, folder).withColumns(ft.bias_pattern_counts(F.col("text"), terms)).drop("text")


def native_features(spark, folder):
    return _rounded(ft.native_features(cleaned(spark, folder)).drop("text"))


def features_of_lines(spark, folder):
    """Features of every line, with NULL and blank lines among them."""
    lines = cleaned(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    # A NULL line more for each document, as line -1.
    none = cleaned(spark, folder).select("doc_id", F.lit(-1).alias("ln"), F.lit(None).cast("string").alias("line"))
    df = lines.unionByName(none)
    return _rounded(ft.native_features(df, "line").drop("line"))


def near_attacks(spark, folder):
    score = ft.near_attack_ratio(F.col("text"))
    return cleaned(spark, folder).select("doc_id", F.round(score, 6).alias("near_attack_ratio"))


def tagged(df):
    """A tagged-token column of cleaned texts by a fixed rule: tag by ending, head by place, seven to a sentence."""

    def token(both: Column, i: Column) -> Column:
        t, low = both["t"], both["low"]
        pos = (
            F.when(low.isin("you", "he", "she", "it", "they", "i"), F.lit("PRON"))
            .when(low.endswith("ly"), F.lit("ADV"))
            .when(low.endswith("ing") | low.endswith("ed"), F.lit("VERB"))
            .when(low.endswith("al"), F.lit("ADJ"))
            .otherwise(F.lit("NOUN"))
        )
        head = F.when(i % 7 == 0, i).otherwise(F.greatest(i - 1 - i % 3, F.lit(0)))
        return F.struct(
            i.alias("i"), t.alias("text"), pos.alias("pos"), head.cast("int").alias("head"),
            F.floor(i / 7).cast("int").alias("sent"),
        )

    def tag(toks: Column) -> Column:
        return F.transform(F.arrays_zip(toks.alias("t"), F.transform(toks, F.lower).alias("low")), token)

    toks = df.withColumn("_toks", tx.tokens_ascii(F.col("text")))
    return toks.withColumn("tagged", let(F.col("_toks"), tag)).drop("_toks")


def tagged_counts(spark, folder):
    df = tagged(cleaned(spark, folder))
    return _rounded(df.select("doc_id", *[c.alias(n) for n, c in ft.pos_counts(F.col("tagged")).items()]))


def tagged_syntax(spark, folder):
    df = tagged(cleaned(spark, folder, spread=True))
    cols = ft.syntax_features(F.col("tagged"))
    return _rounded(df.select("doc_id", *[c.alias(n) for n, c in cols.items()]))


def tagged_by_function(spark, folder):
    """Tag counts from a tagger function run in batches: words between blanks, tag by ending."""

    def load():
        def tag(texts):
            return [
                [(i, w, "VERB" if w.endswith("ing") else "NOUN", max(i - 1, 0), i // 7)
                 for i, w in enumerate(t.split(" ")) if w]
                for t in texts
            ]

        return tag

    df = tag_texts(cleaned(spark, folder, spread=True), load)
    cols = ft.syntax_features(F.col("tagged"))
    return _rounded(
        df.select(
            "doc_id", F.size("tagged").alias("n"), cols["verb_ratio"].alias("verb_ratio"),
            ft.dependency_distance(F.col("tagged")).alias("distance"),
        )
    )


def engineered(spark, folder):
    """Linguistic, bias and the first TF-IDF columns of the cleaned comments."""
    df = engineered_features(
        cleaned(spark, folder, spread=True), "text", lx.IDENTITY_TERMS, max_features=FEATURES
    )
    return _rounded(
        df.select(
            "doc_id", "sentence_count", "avg_word_length", "has_question", "stereotyping_count",
            "derogatory_count", "targeted_hate_count", "us_vs_them_count",
            *[f"tfidf_{i}" for i in range(100)],
        )
    )


def class_feature_profile(spark, folder):
    """Mean of each text feature, toxic against other."""
    df = with_labels(ft.native_features(cleaned(spark, folder)).drop("text"), spark, folder)
    return df.groupBy("toxic").agg(*[F.round(F.avg(c), 6).alias(c) for c in ft.NATIVE_FEATURES])


def first_of_class_features(spark, folder):
    """Features of the first toxic and the first other comment."""
    keys = with_labels(documents(spark, folder).select("doc_id"), spark, folder).select("doc_id", "toxic")
    first = first_per_class(keys, "toxic")
    # One row per class, which meets its text.
    texts = cleaned(spark, folder).join(F.broadcast(first), "doc_id")
    return _rounded(ft.native_features(texts).drop("text"))


def full_feature_table(spark, folder):
    """All model inputs of the manual forest, without a tagger."""
    df = feature_table(comments(spark, folder, spread=True))
    return _rounded(df.select("doc_id", *lx.FEATURE_COLUMNS))


# -- SQL -------------------------------------------------------------------------------------


def _ratio(words, toks="t") -> str:
    hits = f"len(list_filter({toks}, lambda w: lower(w) IN {sql_in(words)}))"
    return f"CASE WHEN len({toks}) = 0 THEN 0 ELSE round({hits} / len({toks})::DOUBLE, 6) END"


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all(lower({text}), {quoted(pattern)}))"


def _share(cls: str, text: str = "text") -> str:
    n = f"len(regexp_extract_all({text}, {quoted(cls)}))"
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE round({n} / length({text})::DOUBLE, 6) END"


HATE = " + ".join(
    _count(p)
    for p in [*lx.HATE_PHRASES, r"(?:hate|despise|can't stand) (?:\w+ )*(?:people|group|community)"]
)
STEREOTYPE = " + ".join(_count(p) for p in lx.STEREOTYPE_PATTERNS)
MEAN_LENGTH = (
    "CASE WHEN len(t) = 0 THEN 0 ELSE round(list_sum(list_transform(t, lambda w: length(w)))"
    " / len(t)::DOUBLE, 6) END"
)


def _sql_native(source: str, keys: str) -> str:
    """The native features of ``text`` in a source that has no NULL text."""
    ratios = {
        "aggressive_word_ratio": lx.AGGRESSIVE_WORDS,
        "generalization_ratio": lx.GENERALIZING_WORDS,
        **{f"{n}_ratio": w for n, w in lx.EMOTION_WORDS.items()},
    }
    listed = ", ".join(f"{_ratio(w)} AS {n}" for n, w in ratios.items())
    return (
        f"SELECT {keys}, len(t) AS word_count, {MEAN_LENGTH} AS avg_word_length,"
        f" len({sql_sentences('text')}) AS sentence_count, {_share('[A-Z]')} AS uppercase_ratio,"
        rf" {_share(r'[!-/:-@\[-`{-~]')} AS punctuation_ratio, {HATE} AS hate_pattern_count,"
        f" {STEREOTYPE} AS stereotype_pattern_count, {listed}"
        f" FROM (SELECT *, {sql_tokens('text')} AS t FROM {source})"
    )


_BIAS_TERMS = "|".join(t for ts in lx.IDENTITY_TERMS.values() for t in ts)

TAGGED = (
    f"tk AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok,"
    f" generate_subscripts({sql_tokens('text')}, 1) - 1 AS i FROM cleaned), "
    "tg AS (SELECT *, CASE WHEN lower(tok) IN ('you', 'he', 'she', 'it', 'they', 'i') THEN 'PRON'"
    " WHEN lower(tok) LIKE '%ly' THEN 'ADV' WHEN lower(tok) LIKE '%ing' OR lower(tok) LIKE '%ed' THEN 'VERB'"
    " WHEN lower(tok) LIKE '%al' THEN 'ADJ' ELSE 'NOUN' END AS pos,"
    " CASE WHEN i % 7 = 0 THEN i ELSE greatest(i - 1 - i % 3, 0) END AS head FROM tk)"
)
_ROOTED = (
    "att AS (SELECT DISTINCT doc_id, head FROM tg"
    f" WHERE head <> i AND lower(tok) IN {sql_in(lx.AGGRESSIVE_WORDS)})"
)


def _sql_full() -> str:
    zeros = ", ".join(
        f"{0 if c == 'imperative_count' else '0::DOUBLE'} AS {c}" for c in ft.TAGGED_FEATURES
    )
    native = _sql_native("(SELECT doc_id, normalized_text AS text FROM marked)", "doc_id")
    return (
        f"WITH {CLEANED}, {IDENTITY}, {_sql_marked(False)}, {_sql_polarity()}, nat AS ({native})"
        f" SELECT {', '.join(lx.FEATURE_COLUMNS)}, doc_id FROM (SELECT *, {zeros},"
        " identity_term_count > 0 AS has_identity_terms, 0::DOUBLE AS identity_context_sentiment"
        " FROM nat JOIN idn USING (doc_id) JOIN polar USING (doc_id))"
    )


QUERIES = {
    "aggression_by_class": Query(
        aggression_by_class,
        "WITH "
        + CLEANED.replace(
            CLEANED[: CLEANED.index(", c1 AS")], "raw AS (SELECT doc_id, text FROM documents)"
        )
        + f" SELECT toxic, count(*) AS n, round(avg(r), 6) AS aggressive_word_ratio FROM (SELECT doc_id,"
        f" CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda w: w IN {sql_in(lx.AGGRESSIVE_WORDS)}))"
        f" / len(t)::DOUBLE END AS r FROM (SELECT doc_id, {sql_tokens('lower(text)')} AS t FROM cleaned))"
        " JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "linguistic_features": Query(
        linguistic_features,
        f"WITH {CLEANED} SELECT doc_id, len({sql_sentences('text')}) AS sentence_count,"
        f" {MEAN_LENGTH} AS avg_word_length, {_share('[A-Z]')} AS capital_ratio,"
        " contains(text, '?') AS has_question, contains(text, '!') AS has_exclamation"
        f" FROM (SELECT *, {sql_tokens('text')} AS t FROM cleaned)",
    ),
    "bias_patterns": Query(
        bias_patterns,
        f"WITH {CLEANED} SELECT doc_id, "
        + ", ".join(
            f"{_count(p.replace('{terms}', _BIAS_TERMS))} AS {n}_count"
            for n, p in lx.BIAS_PATTERNS.items()
        )
        + ", 0 AS identity_followed_by_negative, 0 AS identity_preceded_by_all FROM cleaned",
    ),
    "native_features": Query(
        native_features, f"WITH {CLEANED} {_sql_native('cleaned', 'doc_id')}"
    ),
    "features_of_lines": Query(
        features_of_lines,
        f"WITH {CLEANED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,"
        " generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM cleaned),"
        " b AS (SELECT doc_id, ln, CASE WHEN trim(line) = '' THEN '' ELSE line END AS text FROM l"
        f" UNION ALL SELECT doc_id, -1, '' FROM cleaned) {_sql_native('b', 'doc_id, ln')}",
    ),
    "near_attacks": Query(
        near_attacks,
        f"WITH {CLEANED}, k AS (SELECT doc_id, {sql_tokens('lower(text)')} AS t FROM cleaned),"
        " x AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM k),"
        f" hit AS (SELECT DISTINCT a.doc_id, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id"
        f" AND b.i BETWEEN a.i - 3 AND a.i + 3 WHERE a.tok IN {sql_in(lx.SECOND_PERSON_WORDS)}"
        f" AND b.tok IN {sql_in(lx.AGGRESSIVE_WORDS)}),"
        " c AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1)"
        " SELECT doc_id, coalesce(round(n / len(t)::DOUBLE, 6), 0) AS near_attack_ratio"
        " FROM k LEFT JOIN c USING (doc_id)",
    ),
    "tagged_counts": Query(
        tagged_counts,
        f"WITH {CLEANED}, {TAGGED} SELECT doc_id, count(*) FILTER (pos = 'VERB') AS verb_count,"
        " count(*) FILTER (pos = 'ADJ') AS adj_count, count(*) FILTER (pos = 'PRON') AS pronoun_count,"
        " coalesce(round(avg(abs(i - head)) FILTER (head <> i), 6), 0) AS dependency_distance"
        " FROM tg GROUP BY 1",
    ),
    "tagged_syntax": Query(
        tagged_syntax,
        f"WITH {CLEANED}, {TAGGED}, {_ROOTED} SELECT tg.doc_id,"
        f" round(count(*) FILTER (att.head IS NOT NULL AND lower(tok) IN {sql_in(lx.SECOND_PERSON_WORDS)})"
        " / count(*)::DOUBLE, 6) AS personal_attack_score,"
        + ", ".join(
            f" round(count(*) FILTER (pos = '{p}') / count(*)::DOUBLE, 6) AS {n}_ratio"
            for p, n in (("VERB", "verb"), ("ADJ", "adj"), ("ADV", "adv"), ("PRON", "pronoun"))
        )
        + ", count(*) FILTER (pos = 'VERB' AND i % 7 = 0) AS imperative_count"
        " FROM tg LEFT JOIN att ON tg.doc_id = att.doc_id AND tg.i = att.head GROUP BY 1",
    ),
    "tagged_by_function": Query(
        tagged_by_function,
        f"WITH {CLEANED}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w,"
        " generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM cleaned)"
        " SELECT doc_id, CAST(count(*) AS INT) AS n,"
        " round(count(*) FILTER (w LIKE '%ing') / count(*)::DOUBLE, 6) AS verb_ratio,"
        " coalesce(round(avg(1) FILTER (i > 0), 6), 0) AS distance FROM w WHERE w <> '' GROUP BY 1",
    ),
    "engineered_features": Query(
        engineered,
        f"WITH {TFIDF}, al AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS ix FROM vo),"
        " f3 AS (SELECT * FROM fin JOIN al USING (term) WHERE ix < 100),"
        " bl AS (SELECT c.doc_id, "
        + ", ".join(
            f"round(coalesce(max(CASE WHEN ix = {i} THEN weight END), 0), 6) AS tfidf_{i}"
            for i in range(100)
        )
        + " FROM cleaned c LEFT JOIN f3 USING (doc_id) GROUP BY 1),"
        f" li AS (SELECT doc_id, len({sql_sentences('text')}) AS sentence_count,"
        f" {MEAN_LENGTH} AS avg_word_length, contains(text, '?') AS has_question, "
        + ", ".join(
            f"{_count(p.replace('{terms}', _BIAS_TERMS))} AS {n}_count"
            for n, p in lx.BIAS_PATTERNS.items()
        )
        + f" FROM (SELECT *, {sql_tokens('text')} AS t FROM cleaned))"
        " SELECT * FROM li JOIN bl USING (doc_id)",
    ),
    "class_feature_profile": Query(
        class_feature_profile,
        f"WITH {LABELLED}, nat AS ({_sql_native('labelled', 'doc_id, toxic').replace('round(', '(').replace(', 6)', ')')})"
        " SELECT toxic, "
        + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ft.NATIVE_FEATURES)
        + " FROM nat GROUP BY 1",
    ),
    "first_of_class_features": Query(
        first_of_class_features,
        f"WITH {LABELLED}, f AS (SELECT doc_id, text, toxic FROM (SELECT *, row_number()"
        " OVER (PARTITION BY toxic ORDER BY doc_id) AS rn FROM labelled) WHERE rn = 1)"
        f" {_sql_native('f', 'doc_id, toxic')}",
    ),
    "full_feature_table": Query(full_feature_table, _sql_full()),
}
