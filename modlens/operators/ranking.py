"""Top rows, first rows, and running sums that do not put one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.session import checkpointed
from modlens.sources.tables import small_table


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows in an order; a partial top-k per partition, then one merge."""
    return df.orderBy(*order).limit(k)


def most_frequent(counts: DataFrame, count_col: str, ties: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` rows with the largest counts, for a large ``k``.

    A plain top-k would bring ``k`` rows of every partition into one task. The histogram of the
    counts gives the smallest count that can be among the first ``k``; rows below it are dropped
    where they are, so that little more than ``k`` rows meet. The counts are written to the
    shared folder, as they are read twice and come from a pass over all texts.
    """
    return most_frequent_of(checkpointed(counts), count_col, ties, k)


def most_frequent_of(counts: DataFrame, count_col: str, ties: Sequence[Column], k: int) -> DataFrame:
    """``most_frequent`` of counts that are written already."""
    hist = counts.groupBy(count_col).agg(F.count("*").alias("_m"))
    falling = Window.orderBy(F.col(count_col).desc())  # one row per distinct count
    enough = hist.withColumn("_cum", F.sum("_m").over(falling)).filter(F.col("_cum") >= k)
    floor = F.coalesce(enough.agg(F.max(count_col)).scalar(), F.lit(0))
    kept = counts.filter(F.col(count_col) >= floor)
    return kept.orderBy(F.col(count_col).desc(), *ties).limit(k)


def top_k_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group, with their ``rank``.

    Spark limits each group inside each partition before it shuffles, so a large group moves
    ``k`` rows per partition at most.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_per_class(df: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """The row with the smallest key of each class."""
    return top_k_per(df, [label], [F.col(key).asc()], 1).drop("rank")


def range_buckets(
    df: DataFrame, by: str, value: str, rows_per_bucket: int = 200_000
) -> DataFrame:
    """The frame with ``_bucket``, which rises with ``value`` inside each group.

    Buckets are equal parts of the range of a group's values, eight times as many as its rows ask
    for, so their number grows with the group; the ranges are one row per group. Equal values
    share a bucket. The frame is read twice, so hand in a written one where it is costly.
    """
    ranges = df.groupBy(by).agg(
        F.min(value).cast("double").alias("_low"),
        F.max(value).cast("double").alias("_high"),
        (F.ceil(F.count("*") / rows_per_bucket) * 8).alias("_parts"),
    )
    place = F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    bucket = F.least(F.floor(F.coalesce(place, F.lit(0.0)) * F.col("_parts")), F.col("_parts") - 1)
    return df.join(ranges, by).withColumn("_bucket", bucket.cast("long")).drop("_low", "_high", "_parts")


def running_sums(
    df: DataFrame, by: str, order: str, values: Sequence[str], rows_per_bucket: int = 200_000
) -> DataFrame:
    """Inclusive running sums per group over ascending ``order``, as ``cum_<value>``.

    ``order`` must be distinct inside a group (aggregate first). Sums run inside range buckets;
    the sums of the buckets before are added from a table of one row per bucket.
    """
    b = range_buckets(df, by, order, rows_per_bucket)
    return bucketed_sums(b, by, order, values).drop("_bucket")


def bucketed_sums(b: DataFrame, by: str, order: str, values: Sequence[str]) -> DataFrame:
    """``running_sums`` of a frame that has its ``_bucket`` already."""
    per_bucket = b.groupBy(by, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        by, "_bucket",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(by, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        b.join(offsets, [by, "_bucket"])
        .withColumns({f"cum_{v}": F.sum(v).over(inside) + F.col(f"_o_{v}") for v in values})
        .drop(*[f"_o_{v}" for v in values])
    )
