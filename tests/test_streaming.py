"""Streams whose batches are written once, however often they are run."""

import pytest
from conftest import table
from pyspark.sql import functions as F

from modlens.session import run_dir
from modlens.streaming import scoring
from modlens.streaming.enrich import read_stream


def arrivals(spark, path, files):
    for n in range(files):
        spark.range(n * 10, n * 10 + 10).withColumnRenamed("id", "doc_id").coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def test_batches_are_written_once(spark):
    source, folder, progress = (run_dir(spark, n) for n in ("arrivals", "scored", "progress"))
    double = [lambda df: df.withColumn("p", F.col("doc_id") * 2)]
    scoring.score_stream(arrivals(spark, source, 3), double, folder, progress).awaitTermination()
    rows = scoring.read_batches(spark, folder)
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(30))
    assert {r["batch_id"]: r["rows"] for r in scoring.manifest(spark, folder).collect()} == {0: 10, 1: 10, 2: 10}
    # Run again after its progress is lost: the same batches come, and none is written twice.
    scoring.score_stream(arrivals(spark, source, 0), double, folder, run_dir(spark, "progress")).awaitTermination()
    assert scoring.read_batches(spark, folder).count() == 30
    # More files arrive and the old progress goes on.
    scoring.score_stream(arrivals(spark, source, 2), double, folder, progress).awaitTermination()
    assert scoring.read_batches(spark, folder).count() == 50


def test_a_batch_that_died_is_written_again(spark):
    folder = run_dir(spark, "scored")
    one, two = table(spark, ["a", "b"]), table(spark, ["c"])
    assert scoring.write_batch(one, 0, folder) and not scoring.write_batch(two, 0, folder)
    # Rows without an entry: the run died between the two.
    two.write.parquet(f"{folder}/rows/batch_id=1")
    assert scoring.read_batches(spark, folder).count() == 2
    assert scoring.write_batch(one, 1, folder)
    assert sorted(r["text"] for r in scoring.read_batches(spark, folder).collect()) == ["a", "a", "b", "b"]


def test_a_step_that_fails_leaves_no_batch(spark):
    source, folder, progress = (run_dir(spark, n) for n in ("arrivals", "scored", "progress"))
    stream = arrivals(spark, source, 1)
    stop = lambda df: df.withColumn("p", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        scoring.score_stream(stream, [stop], folder, progress).awaitTermination()
    assert scoring.manifest(spark, folder).count() == 0
    with pytest.raises(FileNotFoundError):
        scoring.read_batches(spark, folder)
    scoring.score_stream(stream, [], folder, progress).awaitTermination()
    assert scoring.read_batches(spark, folder).count() == 10
