"""Comments enriched as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from modlens import lexicons as lx
from modlens.functions.identity import Lexicon
from modlens.plans.manual_forest import feature_table


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_filter: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def enrich(
    stream: DataFrame,
    text_col: str = "text",
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    stop_words: Sequence[str] | None = None,
    scorer: Transformer | None = None,
) -> DataFrame:
    """All text columns, and the scorer's output if one is given.

    Every step works on one row, so it needs no state and no watermark.
    """
    out = feature_table(stream, text_col, lexicon, stop_words=stop_words)
    return scorer.transform(out) if scorer is not None else out


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it as Parquet, and stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
