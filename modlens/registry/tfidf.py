"""TF-IDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens.operators import tfidf
from modlens.registry.inputs import CLEANED, Query, cleaned
from modlens.session import checkpointed

FEATURES = 10_000


def tfidf_vocabulary(spark, folder):
    """The most frequent unigrams and bigrams; the limit is the vocabulary size."""
    return tfidf.vocabulary(checkpointed(cleaned(spark, folder, spread=True)), max_features=FEATURES)


def tfidf_weights(spark, folder):
    docs = checkpointed(cleaned(spark, folder, spread=True))
    model = tfidf.fit_tfidf(docs, max_features=FEATURES)
    return model.long(docs).withColumn("weight", F.round("weight", 6))


def tfidf_block(spark, folder):
    """The first hundred vocabulary columns per document, with their number and sum."""
    return _block(spark, folder, "term")


def tfidf_heavy_block(spark, folder):
    """The hundred columns of greatest weight per document, with their number and sum."""
    return _block(spark, folder, "weight")


def _block(spark, folder, by):
    # Fit, weights and block all read the cleaned texts, so they are written once.
    docs = checkpointed(cleaned(spark, folder, spread=True))
    wide = tfidf.fit_tfidf(docs, max_features=FEATURES).block(docs, 100, by=by)
    names = [f"tfidf_{i}" for i in range(100)]
    total = F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + x)
    used = F.size(F.filter(F.array(*names), lambda x: x > 0))
    return wide.select(
        "doc_id", used.alias("used"), F.round(total, 6).alias("total"),
        *[F.round(n, 6).alias(n) for n in names],
    )


_WORDS = r"regexp_extract_all(lower(text), '\w{2,}')"
TFIDF = (
    f"{CLEANED}, ws AS (SELECT doc_id, {_WORDS} AS w FROM cleaned), "
    "gr AS (SELECT doc_id, unnest(w) AS term FROM ws UNION ALL"
    " SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ws), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY 1, 2), "
    "vo AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY 1"
    f" ORDER BY total DESC, term LIMIT {FEATURES}), "
    "wt AS (SELECT doc_id, term, (1 + ln(tf)) *"
    " (ln((1 + (SELECT count(*) FROM cleaned)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN vo USING (term)), "
    "nm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM wt GROUP BY 1), "
    "fin AS (SELECT doc_id, term, w / n AS weight FROM wt JOIN nm USING (doc_id))"
)

_BLOCK = (
    " AS (SELECT * FROM fin JOIN al USING (term) WHERE ix < 100)"
    " SELECT c.doc_id, count(term) AS used, round(coalesce(sum(weight), 0), 6) AS total,"
    + ", ".join(
        f" round(coalesce(max(CASE WHEN ix = {i} THEN weight END), 0), 6) AS tfidf_{i}" for i in range(100)
    )
    + " FROM cleaned c LEFT JOIN f100 USING (doc_id) GROUP BY 1"
)

QUERIES = {
    "tfidf_vocabulary": Query(tfidf_vocabulary, f"WITH {TFIDF} SELECT term, total, df FROM vo"),
    "tfidf_weights": Query(
        tfidf_weights, f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM fin"
    ),
    "tfidf_heavy_block": Query(
        tfidf_heavy_block,
        f"WITH {TFIDF}, al AS (SELECT term, row_number() OVER (ORDER BY round(sum(weight), 6) DESC, term) - 1 AS ix"
        " FROM fin GROUP BY 1), f100" + _BLOCK,
    ),
    "tfidf_block": Query(
        tfidf_block,
        f"WITH {TFIDF}, al AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS ix FROM vo),"
        " f100" + _BLOCK,
    ),
}
