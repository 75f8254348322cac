"""Tables saved as one unit, joins of bucketed tables, records set apart, vectors of changed texts."""

import time

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from modlens.operators import models
from modlens.session import run_dir
from modlens.sources import manifest, tables, vectors, versions


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_a_reader_meets_all_of_a_save_or_nothing(spark):
    folder = run_dir(spark, "unit")
    old = {"a": table(spark, ["one"]), "b": table(spark, ["two"])}
    assert versions.save_version(spark, old, folder) == 1
    dies = table(spark, ["new"]).withColumn("text", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        versions.save_version(spark, {"a": table(spark, ["new"]), "b": dies}, folder)
    got = versions.load_version(spark, folder)
    assert (texts(got["a"]), texts(got["b"])) == (["one"], ["two"])
    assert versions.save_version(spark, {"a": table(spark, ["x"]), "b": table(spark, ["y"])}, folder) == 2
    # What was opened before stays readable; the newest is read from now on.
    assert texts(got["a"]) == ["one"]
    got = versions.load_version(spark, folder)
    assert (texts(got["a"]), texts(got["b"])) == (["x"], ["y"])
    assert texts(versions.load_version(spark, folder, 1)["b"]) == ["two"]


def test_old_versions_and_dead_saves_go(spark):
    folder = run_dir(spark, "unit")
    for t in ("a", "b", "c"):
        versions.save_version(spark, {"t": table(spark, [t])}, folder)
    table(spark, ["dead"]).write.parquet(f"{folder}/data/dead/t")
    versions.drop_versions(spark, folder, keep=2)
    # A young folder without an entry may be a save that is still going on.
    assert versions.versions(spark, folder) == [2, 3] and len(manifest.names_in(spark, f"{folder}/data")) == 3
    versions.drop_versions(spark, folder, keep=1, idle_seconds=-3600)
    assert versions.versions(spark, folder) == [3] and len(manifest.names_in(spark, f"{folder}/data")) == 1
    assert texts(versions.load_version(spark, folder)["t"]) == ["c"]
    with pytest.raises(FileNotFoundError):
        versions.load_version(spark, folder, 2)


def test_two_saves_at_once_leave_two_whole_versions(spark):
    folder = run_dir(spark, "unit")
    versions.save_version(spark, {"t": table(spark, ["a"])}, folder)
    entry = versions.newest(spark, folder)
    # The other save had counted the same versions before it put its entry.
    manifest.put_entry(spark, f"{folder}/versions/{1:012d}-zz.json", entry | {"data": "elsewhere"})
    assert versions.versions(spark, folder) == [1, 1]
    assert versions.newest(spark, folder)["data"] == "elsewhere"
    assert versions.save_version(spark, {"t": table(spark, ["b"])}, folder) == 2


def test_bucketed_tables_join_without_a_shuffle(spark):
    folder = run_dir(spark, "unit")
    left = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("it's `x`"))
    right = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("r").alias("y"))
    versions.save_version(spark, {"l": left, "r": right, "no_key": table(spark, ["t"]).drop("doc_id")}, folder, "doc_id", 8)
    got = versions.load_version(spark, folder)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = got["l"].join(got["r"], "doc_id")
        grouped = joined.groupBy("doc_id").agg(F.sum("`it's ``x```").alias("s"))
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert grouped.count() == 500 and grouped.agg(F.sum("s")).first()[0] == 500 * 499
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("modlens_")]


def test_an_empty_unit_and_processed_tables(spark):
    folder = run_dir(spark, "processed")
    with pytest.raises(FileNotFoundError):
        tables.load_processed(spark, folder)
    tables.save_processed(table(spark, ["a", "b"]), table(spark, []).drop("doc_id"), folder, buckets=4)
    features, statistics = tables.load_processed(spark, folder)
    assert texts(features) == ["a", "b"] and statistics.count() == 0
    files = versions.newest(spark, folder)["files"]
    assert spark.read.option("header", True).csv(files["identity_features.csv"]).count() == 2


def test_malformed_records_are_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,comment_text,toxic\n1,"good, ""one""\nline two",1\n2,too few\n3,fine,0\n4,x,y,9\n5,"no ""number""",yes\n6,,\n'
    )
    (tmp_path / "b.csv").write_text("id,comment_text,toxic\n7,b,1\n8,also bad,2.x\n")
    good, bad = tables.read_comments_apart(spark, str(tmp_path))
    rows = {r["doc_id"]: (r["text"], r["toxic"]) for r in good.collect()}
    assert rows == {"1": ('good, "one"\nline two', 1), "3": ("fine", 0), "6": (None, None), "7": ("b", 1)}
    got = sorted((r["file"].rpartition("/")[2], r["record"], r["reason"], r["raw"].strip()) for r in bad.collect())
    assert got == [
        ("a.csv", 1, "fields", "2,too few"), ("a.csv", 3, "fields", "4,x,y,9"),
        ("a.csv", 4, "toxic", '5,"no ""number""",yes'), ("b.csv", 1, "toxic", "8,also bad,2.x"),
    ]
    # Counting, which asks for no column, sees the same rows.
    assert (good.count(), bad.count()) == (4, 4)
    with pytest.raises(ValueError, match="label"):
        tables.read_comments_apart(spark, str(tmp_path), tables.comment_schema(["label"]))


def test_a_file_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,comment_text,toxic\n")
    good, bad = tables.read_comments_apart(spark, str(tmp_path))
    assert good.columns == ["doc_id", "text", "toxic"] and good.count() == bad.count() == 0


def length_model():
    # Made inside, as the workers cannot load this module.
    def load():
        def predict(given):
            return np.array([[float(len(t)), 1.0] for t in given], dtype=np.float32)

        return predict

    return load


def test_changed_texts_get_new_vectors(spark):
    path = run_dir(spark, "vectors")
    get = lambda df, **more: sorted(
        (r["doc_id"], r["embedding"][0]) for r in vectors.cached_vectors(df, path, length_model(), **more).collect()
    )
    assert get(table(spark, ["a", "bb", "ccc"])) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert get(table(spark, ["a", "longer", "ccc"])) == [(0, 1.0), (1, 6.0), (2, 3.0)]
    assert spark.read.parquet(path).count() == 4
    # Back to the text of before, and the same row twice: nothing is computed.
    again = table(spark, ["a", "bb", "ccc"])
    assert get(again.union(again)) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert spark.read.parquet(path).count() == 4
    assert get(again, model_name="other") == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert spark.read.parquet(path).count() == 7
    small = run_dir(spark, "vectors")
    vectors.drop_stale(again, path, small)
    assert sorted(r["embedding"][0] for r in spark.read.parquet(small).collect()) == [1.0, 2.0, 3.0]


def test_vectors_without_a_digest_are_computed_again(spark):
    path = run_dir(spark, "vectors")
    old = spark.createDataFrame([(0, [9.0])], "doc_id bigint, embedding array<float>")
    old.write.parquet(path)
    out = vectors.cached_vectors(table(spark, ["a"]), path, length_model())
    assert [r["embedding"][0] for r in out.collect()] == [1.0]


def test_work_side_by_side(spark):
    count = lambda n: spark.range(n).count()
    assert models.side_by_side(spark, [3, 1, 2], count, 2) == {3: 3, 1: 1, 2: 2}
    began = []

    def fails(n):
        began.append(n)
        time.sleep(0.05 * n)
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        models.side_by_side(spark, list(range(50)), fails, 1)
    assert len(began) < 50


def test_fits_side_by_side_give_the_same_forests(spark):
    rows = [(i, [float(i % 7), float(i % 5)], int(i % 7 > 3), int(i % 5 > 2)) for i in range(200)]
    df = models.vectorised(spark.createDataFrame(rows, "doc_id bigint, embedding array<double>, a int, b int"))
    settings = models.ForestSettings(trees=5, depth=3, min_leaf=1)
    one, two = (models.train_and_evaluate(df, df, ["a", "b"], settings, at_once=n) for n in (1, 2))
    assert list(one.models) == list(two.models) == ["a", "b"]
    for label in ("a", "b"):
        assert one.models[label].toDebugString.partition("\n")[2] == two.models[label].toDebugString.partition("\n")[2]
