"""Fitted forests on a stream, each batch written once.

A batch's rows go to a folder of their own, which a re-run of the batch replaces. When they stand, an
entry of the batch is put into the manifest by one rename; a batch that has its entry is not
written again, and readers take the folders of the manifest only. A run that dies at any point
therefore leaves every batch there once or not at all, whatever store holds the folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modlens.session import dealt
from modlens.sources.manifest import is_there, put_entry

Step = Callable[[DataFrame], DataFrame]


def write_batch(batch: DataFrame, batch_id: int, folder: str) -> bool:
    """A batch's rows and then its entry; False if the entry is there already."""
    spark = batch.sparkSession
    entry = f"{folder}/manifest/{batch_id}.json"
    if is_there(spark, entry):
        return False
    data = f"{folder}/rows/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(data)
    put_entry(spark, entry, {"batch_id": batch_id, "rows": spark.read.parquet(data).count(), "path": data})
    return True


def score_stream(stream: DataFrame, steps: list[Step], folder: str, progress: str, key: str = "doc_id") -> StreamingQuery:
    """What has arrived, through all steps (features, vectors, forests), written batch by batch.

    Steps see one batch as a static frame, so they may join and aggregate inside it. A batch's rows
    are dealt over all cores first: one of a single file would otherwise be scored by one task.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = dealt(batch, key)
        for step in steps:
            batch = step(batch)
        write_batch(batch, batch_id, folder)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches that are in the manifest, with ``batch_id``."""
    entries = manifest(spark, folder)
    paths = [r["path"] for r in entries.select("path").collect()]  # one row per batch
    if not paths:
        raise FileNotFoundError(f"no finished batch in {folder}")
    return spark.read.option("basePath", f"{folder}/rows").parquet(*paths).withColumn("batch_id", F.col("batch_id").cast("long"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id, rows and path of every finished batch."""
    schema = "batch_id long, rows long, path string"
    if not is_there(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/manifest")
