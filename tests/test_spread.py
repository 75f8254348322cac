"""Work on texts and vectors is dealt over all cores, however the tables' files are cut."""

import pytest
from pyspark.sql import functions as F

from modlens.operators import models
from modlens.registry import all_queries
from modlens.session import dealt
from modlens.streaming import scoring

SPREAD = ["sentence_split", "polarity", "normalise_table", "tagged_syntax", "tagged_by_function",
          "identity_sentiment", "full_feature_table"]


@pytest.mark.parametrize("name", SPREAD)
def test_texts_of_one_row_group_are_dealt_over_all_cores(spark, folder, name):
    df = all_queries()[name].run(spark, folder)
    cores = spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() >= 4 * cores


def test_a_row_is_dealt_by_its_key_alone(spark):
    df = spark.range(1000).withColumn("text", F.lit("x"))
    cut = [dealt(d, "id").withColumn("at", F.spark_partition_id()) for d in (df.coalesce(1), df.repartition(7))]
    assert cut[0].exceptAll(cut[1]).isEmpty() and cut[0].count() == 1000


def test_only_five_texts_are_cleaned_for_the_sample(spark, folder):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        df = all_queries()["toxic_identity_sample"].run(spark, folder)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # The five rows meet the texts below the cleaning, whose first step stands above the join.
    assert plan.index("https?") < plan.index("Join Inner")


def test_a_forest_does_not_hang_on_how_its_rows_came(spark):
    df = spark.range(400).select(
        F.col("id").alias("doc_id"), ((F.col("id") * 7919 % 101) > 50).cast("int").alias("y"),
        F.array(*[(F.col("id") * k % 101).cast("double") for k in (7919, 31, 17)]).alias("embedding"),
    )
    rows = models.vectorised(df)
    settings = models.ForestSettings(trees=5, depth=3, min_leaf=1)
    one, two = (
        models.train_and_evaluate(r, rows, ["y"], settings).models["y"].toDebugString
        for r in (rows.coalesce(1), rows.orderBy(F.rand(3)).repartition(9))
    )
    assert one.split("\n", 1)[1] == two.split("\n", 1)[1]


def test_a_batch_of_one_file_is_scored_by_all_cores(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(500).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("doc_id long").parquet(source)
    seen = lambda df: df.withColumn("part", F.spark_partition_id())
    out = str(tmp_path / "out")
    scoring.score_stream(stream, [seen], out, str(tmp_path / "progress")).awaitTermination()
    rows = scoring.read_batches(spark, out)
    assert rows.count() == 500
    assert rows.select("part").distinct().count() >= spark.sparkContext.defaultParallelism
