"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the query contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def keep_documents(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is among ``keys`` (a null key matches a null key), all columns."""
    k = keys.select(F.col(key).alias("_kept_key")).distinct()
    return docs.join(k, docs[key].eqNullSafe(k["_kept_key"]), "left_semi")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null meets null; the right side's keys are dropped."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the key as text leaves 2 when divided by 4.

    A null key counts as the empty text.
    """
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2
