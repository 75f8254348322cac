"""Embedding columns against a binary label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _vector(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


def _class_moments(df: DataFrame, vector_col: str, label: str) -> DataFrame:
    """One row: count, mean and sum of squared deviations per dimension, of both classes."""
    v = df.filter(F.col(label).isin(0, 1)).select(
        F.col(label).cast("int").alias("_y"), _vector(vector_col).alias("_v")
    )
    stats = v.groupBy("_y").agg(
        F.count("*").cast("double").alias("n"),
        Summarizer.mean(F.col("_v")).alias("m"),
        Summarizer.variance(F.col("_v")).alias("v"),
    )
    per = stats.select(
        "_y", "n", vector_to_array("m").alias("m"),
        # sum of squared deviations; a class of one row has none
        F.transform(
            vector_to_array("v"), lambda x: F.when(F.col("n") > 1, x).otherwise(0.0) * (F.col("n") - 1)
        ).alias("ss"),
    )

    def of(y: int) -> Column:
        found = F.max(F.when(F.col("_y") == y, F.struct("n", "m", "ss")))
        missing = F.raise_error(F.lit(f"no row of class {y} in column {label}"))
        return F.when(found.isNotNull(), found).otherwise(missing)

    return per.agg(of(0).alias("a"), of(1).alias("b"))


def class_mean_gaps(df: DataFrame, vector_col: str = "embedding", label: str = "label") -> DataFrame:
    """Per dimension the two class means and their absolute difference."""
    one = _class_moments(df, vector_col, label)
    pairs = F.arrays_zip(F.col("b.m").alias("pos"), F.col("a.m").alias("neg"))
    return one.select(F.posexplode(pairs).alias("dimension", "p")).select(
        "dimension",
        F.col("p.pos").alias("positive_mean"),
        F.col("p.neg").alias("negative_mean"),
        F.abs(F.col("p.pos") - F.col("p.neg")).alias("difference"),
    )


def top_gaps(
    df: DataFrame, k: int = 10, vector_col: str = "embedding", label: str = "label"
) -> DataFrame:
    """The ``k`` dimensions with the largest mean difference, in rising order."""
    gaps = class_mean_gaps(df, vector_col, label).select("dimension", "difference")
    top = gaps.orderBy(F.col("difference").desc(), F.col("dimension").desc()).limit(k)
    return top.orderBy("difference", "dimension")


def label_correlation(df: DataFrame, vector_col: str = "embedding", label: str = "label") -> DataFrame:
    """Per dimension its correlation with the 0/1 label.

    Follows from the class counts, means and squared deviations, so the vectors are read once
    and never exploded. NULL where a side does not vary.
    """
    one = _class_moments(df, vector_col, label)
    cols = [F.col(f"{s}.{f}").alias(f"{s}{f}") for s in ("a", "b") for f in ("m", "ss")]
    d = one.select("a.n", F.col("b.n").alias("n1"), F.posexplode(F.arrays_zip(*cols))).toDF(
        "n0", "n1", "dimension", "p"
    )
    n0, n1 = F.col("n0"), F.col("n1")
    gap = F.col("p.bm") - F.col("p.am")
    between = n0 * n1 / (n0 + n1)
    ss_x = F.col("p.ass") + F.col("p.bss") + between * gap * gap
    return d.select(
        "dimension",
        F.try_divide(between * gap, F.sqrt(ss_x * between)).alias("correlation"),
    )


def correlation_histogram(correlations: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of the correlations between their minimum and maximum.

    One row per bin (0 where no correlation falls in it) with its edges.
    """
    every = Window.partitionBy()  # one row per dimension
    low, high = F.min("correlation").over(every), F.max("correlation").over(every)
    known = correlations.filter(F.col("correlation").isNotNull())
    placed = known.withColumns({"low": low, "high": high})
    at = F.floor(F.try_divide(F.col("correlation") - F.col("low"), F.col("high") - F.col("low")) * bins)
    bin_no = F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = placed.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))
    ends = known.agg(F.min("correlation").alias("low"), F.max("correlation").alias("high"))
    bin_rows = ends.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda n: F.col("low") + (F.col("high") - F.col("low")) * n / bins
    edges = bin_rows.select("bin", edge(F.col("bin")).alias("low_edge"), edge(F.col("bin") + 1).alias("high_edge"))
    return edges.join(counts, "bin", "left").fillna({"n": 0})


def gram(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Per dimension ``i``: n, the sum of the dimension, and its products with all dimensions.

    Each partition multiplies its vectors batch by batch into one matrix and gives a row per
    dimension; the rows are summed in a shuffle of partitions x dimensions rows. Null vectors are
    left out; vectors of different lengths stop the job.
    """

    def multiply(batches):
        n, sums, products = 0, None, None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if not len(rows):
                continue
            x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64)
            size = len(rows[0]) if sums is None else len(sums)
            if (np.asarray(rows.value_lengths()) != size).any():
                raise ValueError("vectors of different lengths")
            x = x.reshape(len(rows), size)
            if sums is None:
                sums, products = np.zeros(size), np.zeros((size, size))
            n += len(x)
            sums += x.sum(axis=0)
            products += x.T @ x
        if n:
            arrays = [
                pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()),
                pa.array(sums), pa.array(list(products), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "n", "s", "products"])

    schema = "i int, n long, s double, products array<double>"
    parts = df.select(F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(multiply, schema)
    rows = parts.select("i", "n", "s", array_to_vector("products").alias("v"))
    return rows.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), vector_to_array(Summarizer.sum(F.col("v"))).alias("products")
    )


def covariance(df: DataFrame, vector_col: str = "embedding") -> np.ndarray:
    """Sample covariance of the dimensions, from the Gram matrices of the partitions.

    The driver gets dimensions x dimensions numbers.
    """
    rows = gram(df, vector_col).orderBy("i").collect()
    if not rows:
        return np.zeros((0, 0))
    n, mean = rows[0]["n"], np.array([r["s"] / r["n"] for r in rows])
    return (np.array([r["products"] for r in rows]) - n * np.outer(mean, mean)) / (n - 1)


def component_axes(df: DataFrame, k: int = 2, vector_col: str = "embedding") -> np.ndarray:
    """The first ``k`` components as columns."""
    return PCA(k=k, inputCol="_v", outputCol="_pc").fit(df.select(_vector(vector_col).alias("_v"))).pc.toArray()


def principal_components(
    df: DataFrame, k: int = 2, vector_col: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """Key and coordinates ``pc1`` … of the centred vectors on the first components.

    Each component points so that its largest loading is positive.
    """
    v = df.select(key, _vector(vector_col).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(v)
    mean = v.agg(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    axes = model.pc.toArray()
    shift = mean @ axes
    signs = [1.0 if abs(a.max()) >= abs(a.min()) else -1.0 for a in axes.T]
    arr = vector_to_array("_pc")
    out = model.transform(v)
    return out.select(
        key,
        *[((arr[i] - float(shift[i])) * signs[i]).alias(f"pc{i + 1}") for i in range(k)],
    )
