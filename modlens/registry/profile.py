"""Corpus profile, sequence and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.operators import profile, splits
from modlens.operators.sequences import SequenceEncoder, word_index
from modlens.plans.sequences import corpus_sizing
from modlens.registry.inputs import (
    COMMENTS, SIX_LABELS, SQL_SPACE, Query, comments, labels, read, sql_corpus_words,
)
from modlens.sources.tables import preview

NUM_WORDS = 200_000  # the most that sizing gives


def class_distribution(spark, folder):
    out = profile.class_distribution(labels(spark, folder), lx.LABELS)
    return out.withColumn("percentage", F.round("percentage", 6))


def label_shares(spark, folder):
    """Share of each value of the given quality label."""
    out = profile.value_counts(read(spark, folder, "labels"), "quality", normalize=True)
    return out.withColumn("share", F.round("share", 6))


def language_counts(spark, folder):
    """Documents per language, languages without any among them."""
    docs = read(spark, folder, "documents")
    return profile.value_counts(docs, "lang", categories=["de", "en", "es", "fr", "it"])


def role_counts(spark, folder):
    """Conversation turns per role."""
    return profile.value_counts(read(spark, folder, "conversations"), "role")


def unlabelled(spark, folder):
    """Documents without a label."""
    docs = read(spark, folder, "documents").select("doc_id", "lang")
    return docs.join(read(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


def document_labels(spark, folder):
    """Every document with its labels, where it has any."""
    docs = read(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(labels(spark, folder), "doc_id", "left")


def first_documents(spark, folder):
    """Preview of ten rows."""
    return preview(read(spark, folder, "documents").select("doc_id", "lang", "n_chars"))


def word_frequencies(spark, folder):
    return profile.word_frequencies(comments(spark, folder))


def coverage_reference(spark, folder):
    return profile.coverage(profile.word_frequencies(comments(spark, folder)))


def coverage_true(spark, folder):
    return profile.coverage(profile.word_frequencies(comments(spark, folder)), mode="true")


def length_stats(spark, folder):
    out = profile.length_stats(comments(spark, folder))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("mean_length", "median_length", "p95_length")}
    )


def sizing(spark, folder):
    return corpus_sizing(comments(spark, folder))


def sizing_of_benchmark(spark, folder):
    """Sizing of the small benchmark table."""
    return corpus_sizing(read(spark, folder, "benchmark"), mode="true")


def first_seen_word_ids(spark, folder):
    return word_index(comments(spark, folder), NUM_WORDS)


def word_ids_by_text_key(spark, folder):
    """Ids where the key is text: first seen in the order of the keys as text."""
    keyed = comments(spark, folder).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return word_index(keyed, NUM_WORDS)


def alphabetic_word_ids(spark, folder):
    return word_index(comments(spark, folder), NUM_WORDS, ties="word")


def random_split(spark, folder):
    return splits.random_split(comments(spark, folder).select("doc_id"))


def stratified_split(spark, folder):
    df = splits.stratified_split(labels(spark, folder), "toxic")
    return df.select("doc_id", "toxic", "is_test")


def encoded_sequences(spark, folder):
    """Word ids learnt on the training rows, then the test rows encoded."""
    size = corpus_sizing(comments(spark, folder)).first()
    split = splits.stratified_split(labels(spark, folder), "toxic").select("doc_id", "is_test")
    train = comments(spark, folder).join(split.filter(~F.col("is_test")), "doc_id")
    encoder = SequenceEncoder(size["max_features"]).fit(train, size["maxlen"])
    # Texts are encoded where they are; only their sequences meet the split.
    out = encoder.transform(comments(spark, folder)).join(split.filter("is_test"), "doc_id")
    return out.select("doc_id", F.concat_ws(" ", F.col("sequence").cast("array<string>")).alias("sequence"))


# -- SQL -------------------------------------------------------------------------------------

WORDS = f"{COMMENTS}, wf AS (SELECT word, count(*) AS n FROM (SELECT unnest({sql_corpus_words('text')}) AS word FROM raw) GROUP BY 1)"


def _sql_coverage(mode: str, cte: str) -> str:
    whole = "sum(cum)" if mode == "reference" else "max(cum)"
    return (
        f"{cte}, cu AS (SELECT word, sum(n) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) AS cum FROM wf),"
        f" cv AS (SELECT count(*) AS vocabulary, count(*) FILTER (cum <= 0.9::DOUBLE * (SELECT {whole} FROM cu))"
        " AS covered FROM cu)"
    )


def _sql_lengths(source: str) -> str:
    return (
        f"ln AS (SELECT len(regexp_extract_all(text, '[^{SQL_SPACE}]+')) AS length FROM {source}),"
        " ls AS (SELECT avg(length) AS mean_length, quantile_cont(length, 0.5) AS median_length,"
        " quantile_cont(length, 0.95) AS p95_length FROM ln)"
    )


def _sql_sizing() -> str:
    return (
        "SELECT least(CAST(floor(covered * 1.2::DOUBLE) AS BIGINT), 200000) AS max_features,"
        " CAST(floor(p95_length) AS INT) AS maxlen,"
        " CASE WHEN covered * 1.2 < 50000 THEN 100 WHEN covered * 1.2 < 100000 THEN 200 ELSE 300 END"
        " AS embed_size FROM cv, ls"
    )


def _sql_word_ids(cte: str, order: str, first: str = "min(doc_id * 1000000 + pos)", limit: str = str(NUM_WORDS)) -> str:
    return (
        f"{cte}, wl AS (SELECT doc_id, {sql_corpus_words('text')} AS w FROM src),"
        " wp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM wl),"
        f" wc AS (SELECT word, count(*) AS n, {first} AS first FROM wp GROUP BY 1),"
        f" ids AS (SELECT word, row_number() OVER (ORDER BY n DESC, {order}) AS word_id FROM wc"
        f" QUALIFY word_id < {limit})"
    )


STRATIFIED = (
    f"{SIX_LABELS}, st AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id))"
    " <= floor(count(*) OVER (PARTITION BY toxic) * 0.2::DOUBLE + 0.5) AS is_test FROM six)"
)

QUERIES = {
    "class_distribution": Query(
        class_distribution,
        f"WITH {SIX_LABELS} "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS label_name, CAST(sum({n}) AS BIGINT) AS positives, count(*) AS total,"
            f" round(sum({n}) / count(*)::DOUBLE * 100, 6) AS percentage FROM six"
            for n in lx.LABELS
        ),
    ),
    "label_shares": Query(
        label_shares,
        "SELECT quality, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share"
        " FROM labels GROUP BY 1",
    ),
    "language_counts": Query(
        language_counts,
        "SELECT v.lang, count(doc_id) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(lang)"
        " LEFT JOIN documents d ON d.lang = v.lang GROUP BY 1",
    ),
    "role_counts": Query(
        role_counts, "SELECT role, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1"
    ),
    "unlabelled": Query(
        unlabelled,
        "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "document_labels": Query(
        document_labels,
        f"WITH {SIX_LABELS} SELECT doc_id, lang, n_chars, {', '.join(lx.LABELS)}"
        " FROM documents LEFT JOIN six USING (doc_id)",
    ),
    "first_documents": Query(
        first_documents, "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10"
    ),
    "word_frequencies": Query(word_frequencies, f"WITH {WORDS} SELECT word, n FROM wf"),
    "coverage_reference": Query(
        coverage_reference,
        f"WITH {_sql_coverage('reference', WORDS)} SELECT vocabulary, covered FROM cv",
    ),
    "coverage_true": Query(
        coverage_true, f"WITH {_sql_coverage('true', WORDS)} SELECT vocabulary, covered FROM cv"
    ),
    "length_stats": Query(
        length_stats,
        f"WITH {COMMENTS}, {_sql_lengths('raw')} SELECT round(mean_length, 6) AS mean_length,"
        " round(median_length, 6) AS median_length, round(p95_length, 6) AS p95_length,"
        " CAST(floor(p95_length) AS INT) AS maxlen FROM ls",
    ),
    "sizing": Query(
        sizing,
        f"WITH {_sql_coverage('reference', WORDS)}, {_sql_lengths('raw')} {_sql_sizing()}",
    ),
    "sizing_of_benchmark": Query(
        sizing_of_benchmark,
        "WITH wf AS (SELECT word, count(*) AS n FROM (SELECT unnest("
        f"{sql_corpus_words('text')}) AS word FROM benchmark) GROUP BY 1)"
        f"{_sql_coverage('true', '')}, {_sql_lengths('benchmark')} {_sql_sizing()}",
    ),
    "first_seen_word_ids": Query(
        first_seen_word_ids,
        f"WITH {_sql_word_ids(COMMENTS + ', src AS (SELECT * FROM raw)', 'first')}"
        " SELECT word, word_id FROM ids",
    ),
    "word_ids_by_text_key": Query(
        word_ids_by_text_key,
        "WITH "
        + _sql_word_ids(
            COMMENTS + ", src AS (SELECT * FROM raw)", "first",
            "min(struct_pack(k := CAST(doc_id AS VARCHAR), p := pos))",
        )
        + " SELECT word, word_id FROM ids",
    ),
    "alphabetic_word_ids": Query(
        alphabetic_word_ids,
        f"WITH {_sql_word_ids(COMMENTS + ', src AS (SELECT * FROM raw)', 'word')}"
        " SELECT word, word_id FROM ids",
    ),
    "random_split": Query(
        random_split,
        "SELECT doc_id, substr(md5('42:' || doc_id), 1, 8) < '33333333' AS is_test FROM documents",
    ),
    "stratified_split": Query(
        stratified_split, f"WITH {STRATIFIED} SELECT doc_id, toxic, is_test FROM st"
    ),
    "encoded_sequences": Query(
        encoded_sequences,
        "WITH "
        + _sql_word_ids(
            _sql_coverage("reference", WORDS)
            + f", {_sql_lengths('raw')}, sz AS ({_sql_sizing()}), {STRATIFIED},"
            " src AS (SELECT doc_id, text FROM raw JOIN st USING (doc_id) WHERE NOT is_test)",
            "first",
            limit="(SELECT max_features FROM sz)",
        )
        + f", tw AS (SELECT doc_id, {sql_corpus_words('text')} AS w FROM raw JOIN st USING (doc_id) WHERE is_test),"
        " tp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM tw),"
        " ts AS (SELECT doc_id, list(word_id ORDER BY pos) AS s FROM tp JOIN ids USING (word) GROUP BY 1)"
        f" SELECT doc_id, array_to_string(list_concat(list_transform(range(greatest(maxlen -"
        f" coalesce(len(s), 0), 0)), lambda x: 0::BIGINT), coalesce(s[greatest(len(s) - maxlen, 0) + 1 :], [])),"
        " ' ') AS sequence FROM tw LEFT JOIN ts USING (doc_id), sz",
    ),
}
