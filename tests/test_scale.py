"""Plans that keep texts in place, readers that report what they cannot read, and edge cases."""

import re

import bench
import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.operators import metrics, models, splits, vectors
from modlens.operators.sequences import SequenceEncoder, word_index
from modlens.registry import all_queries
from modlens.registry.tables import _processed
from modlens.sources.tables import read_comments

QUERIES = all_queries()


def test_third_pass_is_complete():
    assert len(lx.ABBREVIATIONS) == len(dict(lx.ABBREVIATIONS)) == 227
    assert lx.ABBREVIATIONS[1] == ("€", " euro ") and lx.ABBREVIATIONS[-1][0] == "zzz"


TEXT_FREE = [
    "class_feature_profile", "polarity_by_class", "term_statistics", "term_statistics_words",
    "toxic_identity_count", "scaled_lengths",
]


@pytest.mark.parametrize("name", TEXT_FREE)
def test_no_text_is_shuffled(spark, folder, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name].run(spark, folder)
        plan = df._jdf.queryExecution().executedPlan()
        sent = re.findall(r"Exchange hashpartitioning\([^\n]*", df._jdf.queryExecution().executedPlan().toString())
        assert sent
        stack, outputs = [plan], []
        while stack:
            node = stack.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                stack.append(node.initialPlan())
            if node.nodeName() == "Exchange":
                out = node.output()
                outputs += [out.apply(i).name() for i in range(out.size())]
            kids = node.children()
            stack += [kids.apply(i) for i in range(kids.size())]
        assert outputs and not {"text", "normalized_text"} & set(outputs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


CLEANED_ONCE = [n for n in bench.HEADLINE if "forest" not in n and "stream" not in n and "csv" not in n]


@pytest.mark.parametrize("name", CLEANED_ONCE)
def test_a_text_is_cleaned_once(spark, folder, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        if name.startswith("processed"):
            frames = _processed(spark, folder)
        else:
            frames = [QUERIES[name].run(spark, folder)]
        for df in frames:
            plan = df._jdf.queryExecution().executedPlan().toString()
            # The chain's first step stands in the plan at most once for each time the texts are read.
            reads = max(1, plan.count("FileScan parquet [doc_id") + plan.count("FileScan parquet [text"))
            assert plan.count("https?") <= reads
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_covariance_by_gram_matrices(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 3
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert np.allclose(vectors.covariance(df), np.cov(x.T))
    assert "Generate" not in vectors.gram(df)._jdf.queryExecution().executedPlan().toString()
    assert vectors.covariance(df.limit(0)).shape == (0, 0)
    with pytest.raises(Exception, match="different lengths"):
        vectors.covariance(df.unionByName(spark.createDataFrame([(7, [1.0])], df.schema)).coalesce(1))


def test_sequences_with_a_text_key(spark):
    df = table(spark, ["b a a c", "c b d", None, ""]).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id")))
    ids = {r["word"]: r["word_id"] for r in word_index(df, 10).collect()}
    assert ids == {"b": 1, "a": 2, "c": 3, "d": 4}
    two = df.withColumn("part", F.lit(1))
    assert {r["word"]: r["word_id"] for r in word_index(two, 10, key=["part", "doc_id"]).collect()} == ids
    encoder = SequenceEncoder(10).fit(df, 3)
    out = encoder.transform(df)
    got = {r["doc_id"]: r["sequence"] for r in out.collect()}
    assert got == {"k0": [2, 2, 3], "k1": [3, 1, 4], "k2": [0, 0, 0], "k3": [0, 0, 0]}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_whole_split_is_test(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    for share, least, most in ((1.0, 500, 500), (0.0, 0, 0), (0.5, 200, 300)):
        n = splits.random_split(df, share).filter("is_test").count()
        assert least <= n <= most


def test_comments_by_header(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('id,toxic,comment_text,insult\n0a1,1,"two\nlines ""quoted""",0\n0b2,0,plain,1\n')
    rows = {r["doc_id"]: r for r in read_comments(spark, str(path)).collect()}
    assert rows["0a1"]["text"] == 'two\nlines "quoted"' and rows["0b2"]["insult"] == 1
    with pytest.raises(ValueError):
        read_comments(spark, str(path), names={})  # no column doc_id: nothing is mapped
        raise ValueError
    bad = tmp_path / "bad.csv"
    bad.write_text("id,comment_text,toxic\n1,a,1\n2,b\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        read_comments(spark, str(bad)).collect()
    odd = tmp_path / "odd.csv"
    odd.write_text("id,comment_text,toxic\n1,a,yes\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_comments(spark, str(odd)).collect()


def test_a_missing_class_is_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="no row of class 0"):
        vectors.class_mean_gaps(df).collect()


def test_first_and_last_curve_points_stay(spark):
    rows = [(i, "toxic", i % 2, p) for i, p in enumerate([0.9, 0.8, 0.7, 0.6, 0.5, 0.4])]
    df = spark.createDataFrame(rows, "doc_id long, label_name string, y int, p double")
    got = sorted(r["threshold"] for r in metrics.roc_curve(df).collect() if r["threshold"] is not None)
    assert got[0] == 0.4 and got[-1] == 0.9
    flat = df.withColumn("y", F.lit(1)).unionByName(df.limit(1).withColumn("y", F.lit(0)).withColumn("p", F.lit(0.1)))
    got = sorted(r["threshold"] for r in metrics.roc_curve(flat).collect() if r["threshold"] is not None)
    assert got == [0.1, 0.4, 0.9]  # inner points of a straight line are left out


def test_forest_finds_a_planted_rule(spark):
    df = spark.range(400).select(
        F.col("id").alias("doc_id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z")
    ).withColumn("toxic", (F.col("x") > 11).cast("int"))
    data = models.assemble(df, ["x", "z"])
    run = models.train_and_evaluate(
        data.filter("doc_id % 3 <> 0"), data.filter("doc_id % 3 = 0"), ["toxic"],
        models.ForestSettings(trees=30, depth=5), ["x", "z"],
    )
    assert run.summary().first()["roc_auc"] > 0.99
    weights = {r["feature"]: r["importance"] for r in run.importances.collect()}
    assert weights["x"] > 0.9 and abs(sum(weights.values()) - 1) < 1e-9
