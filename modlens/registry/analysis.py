"""Error and confidence queries over the score table and the comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens.operators import analysis as an
from modlens.registry.inputs import COMMENTS, SCORES, Query, comments, scores


def _toxic(spark, folder):
    return scores(spark, folder).filter(F.col("label_name") == "toxic")


def scored_texts(spark, folder):
    """Scores of the toxic label with text and readable class."""
    out = an.with_text(_toxic(spark, folder), comments(spark, folder))
    return an.confidence(out).select("doc_id", "text", "p", "actual", "confidence_level")


def most_toxic(spark, folder):
    return an.with_text(an.most_toxic(_toxic(spark, folder)), comments(spark, folder)).select(
        "doc_id", "text", "p"
    )


def least_toxic(spark, folder):
    return an.with_text(an.least_toxic(_toxic(spark, folder)), comments(spark, folder)).select(
        "doc_id", "text", "p"
    )


def false_positives(spark, folder):
    return an.false_positives(scores(spark, folder)).select("doc_id", "label_name", "p")


def false_negatives(spark, folder):
    return an.false_negatives(scores(spark, folder)).select("doc_id", "label_name", "p")


def error_counts(spark, folder):
    return an.error_counts(scores(spark, folder))


def misclassified_samples(spark, folder):
    out = an.with_text(an.misclassified(scores(spark, folder)), comments(spark, folder))
    return out.select("doc_id", "label_name", "y", "p", "rank", "text")


def confidence_counts(spark, folder):
    return an.confidence_counts(_toxic(spark, folder))


def borderline_cases(spark, folder):
    return an.borderline_cases(_toxic(spark, folder)).select("doc_id", "p", "actual")


def high_confidence_correct(spark, folder):
    return an.high_confidence_correct(scores(spark, folder)).select("doc_id", "label_name", "p", "actual")


def confident_positives(spark, folder):
    return an.confident_positives(scores(spark, folder)).select("doc_id", "label_name", "p")


_BIN = (
    "CASE WHEN p > 0 AND p <= 0.2::DOUBLE THEN 'Very Low' WHEN p > 0.2::DOUBLE AND p <= 0.4::DOUBLE THEN 'Low'"
    " WHEN p > 0.4::DOUBLE AND p <= 0.6::DOUBLE THEN 'Moderate' WHEN p > 0.6::DOUBLE AND p <= 0.8::DOUBLE"
    " THEN 'High' WHEN p > 0.8::DOUBLE AND p <= 1 THEN 'Very High' END"
)
_ACTUAL = "CASE WHEN y = 1 THEN 'Toxic' ELSE 'Non-toxic' END"
TOXIC = f"{SCORES}, tox AS (SELECT *, {_BIN} AS confidence_level, {_ACTUAL} AS actual FROM scored WHERE label_name = 'toxic')"

QUERIES = {
    "scored_texts": Query(
        scored_texts,
        f"WITH {COMMENTS}, {TOXIC} SELECT doc_id, text, p, actual, confidence_level FROM tox JOIN raw USING (doc_id)",
    ),
    "most_toxic": Query(
        most_toxic,
        f"WITH {COMMENTS}, {TOXIC} SELECT doc_id, text, p FROM tox JOIN raw USING (doc_id) WHERE y = 1"
        " ORDER BY p DESC, doc_id LIMIT 5",
    ),
    "least_toxic": Query(
        least_toxic,
        f"WITH {COMMENTS}, {TOXIC} SELECT doc_id, text, p FROM tox JOIN raw USING (doc_id) WHERE y = 0"
        " ORDER BY p, doc_id LIMIT 5",
    ),
    "false_positives": Query(
        false_positives,
        f"WITH {SCORES} SELECT doc_id, label_name, p FROM scored WHERE yhat = 1 AND y = 0",
    ),
    "false_negatives": Query(
        false_negatives,
        f"WITH {SCORES} SELECT doc_id, label_name, p FROM scored WHERE yhat = 0 AND y = 1",
    ),
    "error_counts": Query(
        error_counts,
        f"WITH {SCORES} SELECT label_name, count(*) FILTER (yhat = 1 AND y = 0) AS false_positives,"
        " count(*) FILTER (yhat = 0 AND y = 1) AS false_negatives FROM scored GROUP BY 1",
    ),
    "misclassified_samples": Query(
        misclassified_samples,
        f"WITH {COMMENTS}, {SCORES}, w AS (SELECT *, row_number() OVER (PARTITION BY label_name, y ORDER BY doc_id)"
        " AS rank FROM scored WHERE yhat <> y) SELECT doc_id, label_name, y, p, rank, text FROM w"
        " JOIN raw USING (doc_id) WHERE rank <= 3",
    ),
    "confidence_counts": Query(
        confidence_counts,
        f"WITH {TOXIC} SELECT v.confidence_level, count(doc_id) AS n FROM (VALUES ('Very Low'), ('Low'),"
        " ('Moderate'), ('High'), ('Very High')) v(confidence_level) LEFT JOIN tox"
        " ON tox.confidence_level = v.confidence_level GROUP BY 1",
    ),
    "borderline_cases": Query(
        borderline_cases,
        f"WITH {TOXIC} SELECT doc_id, p, actual FROM tox WHERE p > 0.4::DOUBLE AND p < 0.6::DOUBLE",
    ),
    "high_confidence_correct": Query(
        high_confidence_correct,
        f"WITH {SCORES} SELECT doc_id, label_name, p, {_ACTUAL} AS actual FROM scored"
        " WHERE (p > 0.9::DOUBLE AND y = 1) OR (p < 0.1::DOUBLE AND y = 0)",
    ),
    "confident_positives": Query(
        confident_positives,
        f"WITH {SCORES} SELECT doc_id, label_name, p FROM scored WHERE y = 1 AND p > 0.9::DOUBLE",
    ),
}
