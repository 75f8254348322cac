"""Train/test splits that depend on the key only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_hash(key: Column, seed: int = 42) -> Column:
    """Hex digest of seed and key: the same on every run and layout."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def random_split(
    df: DataFrame, test_share: float = 0.2, key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """The frame with ``is_test``, true for about the given share; no shuffle."""
    place = F.conv(F.substring(split_hash(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", place < int(test_share * 16**8))


def stratified_split(
    df: DataFrame, stratum: str, test_share: float = 0.2, key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """The frame with ``is_test``, true for the given share of each stratum, to the row.

    The rows with the smallest digests of a stratum are its test rows. Counts over a million
    digest buckets show in which bucket the cut falls; only the rows of that bucket are ranked.
    The cut goes back as one row per stratum.
    """
    digest = split_hash(F.col(key), seed)
    hashed = df.select(stratum, digest.alias("_h")).withColumn("_b", F.substring("_h", 1, 5))
    counts = hashed.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(stratum)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_bucket = (
        counts.withColumn("_cum", F.sum("_n").over(upto))
        .withColumn("_target", F.floor(F.sum("_n").over(whole) * test_share + 0.5))
        .filter((F.col("_cum") >= F.col("_target")) & (F.col("_cum") - F.col("_n") < F.col("_target")))
        .select(stratum, "_b", (F.col("_target") - (F.col("_cum") - F.col("_n"))).alias("_need"))
    )
    ranked = hashed.join(cut_bucket, [stratum, "_b"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h"))
    )
    cuts = ranked.filter(F.col("_r") == F.col("_need")).select(stratum, F.col("_h").alias("_cut"))
    return (
        df.join(cuts, stratum, "left")
        .withColumn("is_test", F.coalesce(digest <= F.col("_cut"), F.lit(False)))
        .drop("_cut")
    )
