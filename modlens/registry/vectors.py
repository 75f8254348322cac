"""Embedding queries; the given label (0 to 9) is made binary: 5 and above."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from modlens.operators import vectors as vc
from modlens.registry.inputs import Query, read
from modlens.session import run_dir
from modlens.sources.tables import small_table
from modlens.sources.vectors import cached_vectors, embed_texts


def embeddings(spark, folder):
    """vec_id, embedding, y."""
    df = read(spark, folder, "embeddings")
    return df.select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"))


def class_mean_gaps(spark, folder):
    out = vc.class_mean_gaps(embeddings(spark, folder), label="y")
    return out.select(
        "dimension",
        *[F.round(c, 6).alias(c) for c in ("positive_mean", "negative_mean", "difference")],
    )


def top_gaps(spark, folder):
    """The ten dimensions that differ most between the classes."""
    return vc.top_gaps(embeddings(spark, folder), label="y").withColumn(
        "difference", F.round("difference", 6)
    )


def label_correlation(spark, folder):
    out = vc.label_correlation(embeddings(spark, folder), label="y")
    return out.withColumn("correlation", F.round("correlation", 6))


def correlation_histogram(spark, folder):
    out = vc.correlation_histogram(vc.label_correlation(embeddings(spark, folder), label="y"))
    return out.withColumns({c: F.round(c, 6) for c in ("low_edge", "high_edge")})


def principal_components(spark, folder):
    """Two coordinates per vector, with the class."""
    df = embeddings(spark, folder)
    return vc.principal_components(df).join(df.select("vec_id", "y"), "vec_id")


def component_moments(spark, folder):
    """Mean of each coordinate (0) and their covariance (0), rounded."""
    pcs = vc.principal_components(embeddings(spark, folder))
    return pcs.select(
        F.round(F.abs(F.avg("pc1")), 4).alias("mean_1"),
        F.round(F.abs(F.avg("pc2")), 4).alias("mean_2"),
        F.round(F.abs(F.covar_pop("pc1", "pc2")), 4).alias("covariance"),
        F.count("*").alias("n"),
    )


def component_checks(spark, folder):
    """Per component: length of its axis, what the covariance leaves of it, variance of its coordinate.

    The axis has length 1; covariance x axis = eigenvalue x axis, so the residual is 0; the
    coordinate varies as the eigenvalue says, and the first at least as much as any dimension.
    """
    df = embeddings(spark, folder)
    axes = vc.component_axes(df)
    cov = vc.covariance(df)
    pcs = vc.principal_components(df)
    spread = pcs.agg(F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2")).first()
    rows = []
    for i in range(2):
        a = axes[:, i]
        eigen = float(a @ cov @ a)
        rows.append(
            (
                i + 1, round(float(np.linalg.norm(a)), 6), round(float(np.abs(cov @ a - eigen * a).max()), 6),
                round(spread[i] / eigen, 6), bool(float(spread[0]) >= cov.diagonal().max()), pcs.count(),
            )
        )
    schema = "component int, axis_length double, residual double, variance_ratio double, widest boolean, n long"
    return small_table(spark, rows, schema)


def shape_model():
    """Loader of a stand-in model: text length and the counts of four letters.

    The loader is a local function, so Spark ships its code and workers need not import it.
    """

    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            rows = [[len(t), *[t.count(c) for c in "aent"]] for t in texts]
            return np.array(rows, dtype=np.float32)

        return predict

    return load


def _flat(df):
    return df.select(
        "doc_id",
        *[F.get("embedding", F.lit(i)).cast("bigint").alias(f"v{i}") for i in range(5)],
    )


def embedded_texts(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return _flat(embed_texts(docs, shape_model()))


def kept_vectors(spark, folder):
    """Vectors of the English documents kept first, then of all; the second run adds the rest."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    path = run_dir(spark, "vectors")
    cached_vectors(docs.filter(F.col("lang") == "en"), path, shape_model())
    return _flat(cached_vectors(docs, path, shape_model()))


def refreshed_vectors(spark, folder):
    """Vectors kept of all documents, then again after the text of each third has changed."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    path = run_dir(spark, "vectors")
    before = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("an earlier text "), "text")).otherwise(F.col("text"))
    cached_vectors(docs.withColumn("text", before), path, shape_model())
    return _flat(cached_vectors(docs, path, shape_model()))


LONG = (
    "ev AS (SELECT vec_id, CAST(label >= 5 AS INT) AS y, unnest(embedding)::DOUBLE AS x,"
    " generate_subscripts(embedding, 1) - 1 AS dimension FROM embeddings), "
    "gp AS (SELECT dimension, avg(x) FILTER (y = 1) AS positive_mean, avg(x) FILTER (y = 0) AS negative_mean"
    " FROM ev GROUP BY 1), "
    "co AS (SELECT dimension, corr(x, y) AS c FROM ev GROUP BY 1)"
)
_SHAPE = (
    "SELECT doc_id, length(text) AS v0, "
    + ", ".join(
        f"length(text) - length(replace(text, '{c}', '')) AS v{i + 1}" for i, c in enumerate("aent")
    )
    + " FROM documents"
)

QUERIES = {
    "class_mean_gaps": Query(
        class_mean_gaps,
        f"WITH {LONG} SELECT dimension, round(positive_mean, 6) AS positive_mean,"
        " round(negative_mean, 6) AS negative_mean,"
        " round(abs(positive_mean - negative_mean), 6) AS difference FROM gp",
    ),
    "top_gaps": Query(
        top_gaps,
        f"WITH {LONG} SELECT dimension, round(abs(positive_mean - negative_mean), 6) AS difference"
        " FROM gp ORDER BY abs(positive_mean - negative_mean) DESC LIMIT 10",
    ),
    "label_correlation": Query(
        label_correlation, f"WITH {LONG} SELECT dimension, round(c, 6) AS correlation FROM co"
    ),
    "correlation_histogram": Query(
        correlation_histogram,
        f"WITH {LONG}, e AS (SELECT min(c) AS lo, max(c) AS hi FROM co),"
        " b AS (SELECT CAST(least(floor((c - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n FROM co, e"
        " GROUP BY 1) SELECT CAST(r.bin AS INT) AS bin, round(lo + (hi - lo) * r.bin / 50, 6) AS low_edge,"
        " round(lo + (hi - lo) * (r.bin + 1) / 50, 6) AS high_edge, coalesce(n, 0) AS n"
        " FROM range(50) r(bin) LEFT JOIN b ON b.bin = r.bin, e",
    ),
    "principal_components": Query(principal_components),
    "component_moments": Query(
        component_moments,
        "SELECT 0::DOUBLE AS mean_1, 0::DOUBLE AS mean_2, 0::DOUBLE AS covariance, count(*) AS n FROM embeddings",
    ),
    "component_checks": Query(
        component_checks,
        "SELECT CAST(c AS INT) AS component, 1::DOUBLE AS axis_length, 0::DOUBLE AS residual,"
        " 1::DOUBLE AS variance_ratio, true AS widest, count(*) AS n FROM embeddings, range(1, 3) r(c) GROUP BY c",
    ),
    "embedded_texts": Query(embedded_texts, _SHAPE),
    "kept_vectors": Query(kept_vectors, _SHAPE),
    "refreshed_vectors": Query(refreshed_vectors, _SHAPE),
}
