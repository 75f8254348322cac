"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import text as tx
from modlens.operators.identity import identity_columns, term_statistics
from modlens.registry.features import QUERIES as FEATURES
from modlens.registry.identity import LABELLED, SQL_COUNTS, SQL_TOTAL
from modlens.registry.identity import QUERIES as IDENTITY_QUERIES
from modlens.registry.inputs import (
    COMMENTS, PRINTABLE, SIX_LABELS, Query, cleaned, commented, comments, document_stream, labelled, labels,
    sql_expanded,
    with_labels,
)
from modlens.session import dealt, run_dir
from modlens.sources.tables import (
    comment_schema, load_processed, read_comments, read_comments_apart, read_substitutions, save_processed,
    small_table, write_csv,
)
from modlens.sources.versions import load_version, save_version
from modlens.streaming.enrich import enrich, write_available


def csv_round_trip(spark, folder):
    """Labelled comments written as CSV and read back; the text holds line breaks and quotes."""
    df = labelled(spark, folder, clean=False).withColumn("text", F.concat(F.lit('"'), "text"))
    path = run_dir(spark, "comments")
    write_csv(df.select("doc_id", "text", *lx.LABELS), path)
    return read_comments(spark, path, comment_schema())


def _processed(spark, folder):
    texts = cleaned(spark, folder)
    features = with_labels(identity_columns(texts).drop("text"), spark, folder)
    return features, term_statistics(texts, labels=labels(spark, folder))


def processed_round_trip(spark, folder):
    """Identity features saved, loaded, and counted by the flag."""
    path = run_dir(spark, "processed")
    save_processed(*_processed(spark, folder), path)
    features, _ = load_processed(spark, path)
    return features.groupBy("has_identity_terms").agg(
        F.count("*").alias("n"), F.sum("identity_term_count").alias("mentions")
    )


def processed_statistics(spark, folder):
    """Term statistics saved and loaded."""
    path = run_dir(spark, "processed")
    save_processed(*_processed(spark, folder), path)
    _, stats = load_processed(spark, path)
    return stats.select("category", "term", "total_mentions", "toxic_mentions")


def saved_join(spark, folder):
    """Features and labels saved as one bucketed unit, loaded and joined by key without a shuffle."""
    features, _ = _processed(spark, folder)
    path = run_dir(spark, "bucketed")
    tables = {"features": features.drop(*lx.LABELS), "labels": labels(spark, folder)}
    save_version(spark, tables, path, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    saved = load_version(spark, path)
    return saved["features"].join(saved["labels"], "doc_id").select("doc_id", "identity_term_count", *lx.LABELS)


def records_apart(spark, folder):
    """Labelled comments as CSV, each eleventh with a label that is no number: good rows, and the others by reason."""
    df = labelled(spark, folder, clean=False).withColumn("text", F.concat(F.lit('"'), "text"))
    wrong = F.when(F.col("doc_id") % 11 == 0, "yes").otherwise(F.col("threat").cast("string"))
    path = run_dir(spark, "comments")
    write_csv(df.withColumn("threat", wrong).select("doc_id", "text", *lx.LABELS), path)
    good, bad = read_comments_apart(spark, path, comment_schema())
    rows = good.select("doc_id", F.lit("good").alias("reason"), F.length("text").alias("n"))
    # The key stands first in a record that is given as it was.
    keys = F.from_csv("raw", "doc_id bigint", {"escape": '"', "mode": "PERMISSIVE"})["doc_id"]
    return rows.unionByName(bad.select(keys.alias("doc_id"), "reason", F.lit(None).cast("int").alias("n")))


def dictionary_from_file(spark, folder):
    """Shorthand expanded with a dictionary read from a file."""
    rows = [(i + 1, n, k, v) for i, p in enumerate(lx.SUBSTITUTION_PASSES) for n, (k, v) in enumerate(p)]
    path = run_dir(spark, "dictionary")
    write_csv(small_table(spark, rows, "pass int, ord int, key string, replacement string"), path)
    passes = read_substitutions(spark, path)
    df = comments(spark, folder).withColumn("text", tx.keep_printable(F.col("text")))
    return df.select("doc_id", tx.expand_all(F.col("text"), passes).alias("text"))


def stream_enrich(spark, folder):
    """The documents as a stream, enriched with all text columns and appended as Parquet."""
    out = enrich(commented(dealt(document_stream(spark, folder), "doc_id")))
    path = run_dir(spark, "enriched")
    query = write_available(out.select("doc_id", *lx.FEATURE_COLUMNS), path, run_dir(spark, "progress"))
    query.awaitTermination()
    kept = spark.read.parquet(path)
    doubles = [f.name for f in kept.schema if f.dataType.simpleString() == "double"]
    return kept.withColumns({c: F.round(c, 6) for c in doubles})


def _sql_expanded_all() -> str:
    ctes = [COMMENTS, f"e0 AS (SELECT doc_id, {PRINTABLE} AS text FROM raw)"]
    for i, p in enumerate(lx.SUBSTITUTION_PASSES):
        ctes.append(f"e{i + 1} AS (SELECT doc_id, {sql_expanded('text', p)} AS text FROM e{i})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, text FROM e{len(lx.SUBSTITUTION_PASSES)}"


QUERIES = {
    "csv_round_trip": Query(
        csv_round_trip,
        f"WITH {COMMENTS}, {SIX_LABELS} SELECT doc_id, chr(34) || text AS text, {', '.join(lx.LABELS)}"
        " FROM raw JOIN six USING (doc_id)",
    ),
    "processed_round_trip": Query(
        processed_round_trip,
        f"WITH {LABELLED}, ic AS (SELECT *, {SQL_COUNTS} FROM labelled),"
        f" idn AS (SELECT *, {SQL_TOTAL} AS n FROM ic)"
        " SELECT n > 0 AS has_identity_terms, count(*) AS n, CAST(sum(n) AS BIGINT) AS mentions"
        " FROM idn GROUP BY 1",
    ),
    "processed_statistics": Query(
        processed_statistics,
        "SELECT category, term, total_mentions, toxic_mentions FROM"
        f" ({IDENTITY_QUERIES['term_statistics'].sql})",
    ),
    "saved_join": Query(
        saved_join,
        f"WITH {LABELLED}, ic AS (SELECT *, {SQL_COUNTS} FROM labelled)"
        f" SELECT doc_id, {SQL_TOTAL} AS identity_term_count, {', '.join(lx.LABELS)} FROM ic",
    ),
    "records_apart": Query(
        records_apart,
        f"WITH {COMMENTS}, {SIX_LABELS} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'threat' ELSE 'good' END AS reason,"
        " CASE WHEN doc_id % 11 <> 0 THEN length(text) + 1 END AS n FROM raw JOIN six USING (doc_id)",
    ),
    "dictionary_from_file": Query(dictionary_from_file, _sql_expanded_all()),
    "stream_enrich": Query(stream_enrich, FEATURES["full_feature_table"].sql),
}
