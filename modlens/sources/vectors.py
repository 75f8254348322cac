"""Text vectors from a user's model, kept in a table keyed by document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST = "digest"
BatchModel = Callable[[np.ndarray], np.ndarray]


def embed_texts(
    df: DataFrame,
    make_model: Callable[[], BatchModel],
    text_col: str = "text",
    key: str = "doc_id",
    batch_size: int = 32,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Key, columns to keep and ``embedding``: the model is loaded once per worker and called per batch."""
    vector = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.select(key, *keep, vector(text_col).alias("embedding"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept vectors of all texts and models so far, or None if there are none yet."""
    try:
        kept = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # Vectors kept before there was a digest are of unknown texts.
    return kept if DIGEST in kept.columns else kept.withColumn(DIGEST, F.lit(None).cast("string"))


def text_digest(text: Column, model_name: str = "") -> Column:
    """What a vector was made from: the text, null apart from empty, and the name of the model."""
    return F.sha2(F.concat_ws("\n", F.lit(model_name), F.when(text.isNull(), "null").otherwise("text"), text), 256)


def cached_vectors(
    df: DataFrame,
    path: str,
    make_model: Callable[[], BatchModel],
    text_col: str = "text",
    key: str = "doc_id",
    batch_size: int = 32,
    model_name: str = "",
) -> DataFrame:
    """Vectors of all rows of ``df``; only rows without a vector of their present text meet the model.

    A vector is kept with a digest of its text and of ``model_name``: where a text has changed, or the
    name, a new vector is appended to the table at ``path`` and returned from then on. Rows that are
    the same in key and text share one vector; a key with several texts has one for each.
    """
    spark = df.sparkSession
    wanted = df.select(key, text_col).withColumn(DIGEST, text_digest(F.col(text_col), model_name))
    at = [key, DIGEST]
    kept = read_vectors(spark, path)
    missing = wanted if kept is None else wanted.join(kept.select(at), at, "left_anti")
    new = embed_texts(missing.dropDuplicates(at), make_model, text_col, key, batch_size, keep=[DIGEST])
    new.write.mode("append").parquet(path)
    return read_vectors(spark, path).join(wanted.select(at), at, "left_semi").select(key, "embedding")


def drop_stale(df: DataFrame, path: str, into: str, text_col: str = "text", key: str = "doc_id",
               model_name: str = "") -> None:
    """Write the kept vectors that the rows of ``df`` still use to a new table, without the others."""
    at = [key, DIGEST]
    used = df.select(key, text_digest(F.col(text_col), model_name).alias(DIGEST))
    read_vectors(df.sparkSession, path).join(used, at, "left_semi").write.parquet(into)
