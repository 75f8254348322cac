import math

import numpy as np
import pytest
from conftest import table
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import features as ft
from modlens.operators import analysis, metrics, models, profile, splits, vectors
from modlens.operators.ranking import range_buckets, running_sums, top_k_per
from modlens.operators.sequences import SequenceEncoder, word_index
from modlens.operators.tfidf import fit_tfidf
from modlens.plans import embedding_forest, manual_forest
from modlens.plans.engineered import engineered_features
from modlens.sources import tables as src
from modlens.sources.taggers import tag_texts
from modlens.sources.vectors import cached_vectors
from modlens.streaming.enrich import enrich, read_stream, write_available

TAGGED = [
    # "You stupid idiot": both others depend on "you"
    [(0, "You", "PRON", 0, 0), (1, "stupid", "ADJ", 0, 0), (2, "idiot", "NOUN", 0, 0)],
    # two sentences, both begin with a verb
    [(0, "Go", "VERB", 0, 0), (1, "now", "ADV", 0, 0), (2, "Stop", "VERB", 2, 1), (3, "it", "PRON", 2, 1)],
    [],
]


def test_tagged_features(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TAGGED)], f"doc_id int, t {ft.TAGGED_TYPE}")
    cols = ft.pos_counts(F.col("t")) | ft.syntax_features(F.col("t"))
    rows = df.withColumns(cols).orderBy("doc_id").collect()
    assert rows[0]["personal_attack_score"] == pytest.approx(1 / 3)
    assert rows[0]["dependency_distance"] == 1.5
    assert (rows[1]["imperative_count"], rows[1]["verb_ratio"], rows[1]["adv_ratio"]) == (2, 0.5, 0.25)
    assert all(rows[2][c] == 0 for c in cols)


def test_feature_table_has_all_inputs(spark):
    df = table(spark, ["You people are stupid, I hate old people!", None, " "], toxic=[1, 0, 0])
    rows = manual_forest.feature_table(df).orderBy("doc_id").collect()
    assert set(lx.FEATURE_COLUMNS) <= set(rows[0].asDict())
    # "you people", and "hate old people"
    assert (rows[0]["hate_pattern_count"], rows[0]["age_mentions"]) == (2, 1)
    assert all(rows[i][c] == 0 for i in (1, 2) for c in lx.FEATURE_COLUMNS)


def test_tfidf_against_numpy(spark):
    texts = ["The café café cat", "cat sat", "", "dog"]
    df = table(spark, texts)
    model = fit_tfidf(df, max_features=50)
    grams = [["the", "cafe", "cafe", "cat", "the cafe", "cafe cafe", "cafe cat"], ["cat", "sat", "cat sat"], [], ["dog"]]
    vocab = sorted({g for gs in grams for g in gs})
    assert model.vocabulary == vocab
    got = {(r["doc_id"], r["term"]): r["weight"] for r in model.long(df).collect()}
    for i, gs in enumerate(grams):
        w = {}
        for g in set(gs):
            n_docs = sum(g in other for other in grams)
            w[g] = (1 + math.log(gs.count(g))) * (math.log((1 + 4) / (1 + n_docs)) + 1)
        norm = math.sqrt(sum(x * x for x in w.values()))
        for g, x in w.items():
            assert got.pop((i, g)) == pytest.approx(x / norm)
    assert not got
    wide = model.block(df, 100).orderBy("doc_id").collect()
    assert wide[3][f"tfidf_{vocab.index('dog')}"] == 1.0
    assert wide[0]["tfidf_99"] == 0.0
    assert model.block(df, 3, by="idf").columns[-3:] == ["tfidf_0", "tfidf_1", "tfidf_2"]


PREDS = [
    (i, "a", y, p)
    for i, (y, p) in enumerate([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.2), (1, 0.4), (0, 0.0), (0, 1.0)])
] + [(i, "none", 0, 0.1 * i) for i in range(5)]


def preds(spark):
    df = spark.createDataFrame(PREDS, "doc_id bigint, label_name string, y int, p double")
    return df.withColumn("yhat", (F.col("p") > 0.45).cast("int"))


def test_metrics_of_missing_class(spark):
    report = {(r["label_name"], r["class_name"]): r for r in metrics.classification_report(preds(spark)).collect()}
    assert report[("none", "1")]["f1"] == 0.0 and report[("none", "1")]["support"] == 0
    auc = {r["label_name"]: r["roc_auc"] for r in metrics.roc_auc(preds(spark)).collect()}
    pos = [p for _, l, y, p in PREDS if l == "a" and y == 1]
    neg = [p for _, l, y, p in PREDS if l == "a" and y == 0]
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg]
    assert auc["a"] == pytest.approx(sum(pairs) / len(pairs))
    assert auc["none"] is None


def test_thresholds(spark):
    grid = {"a": [0.1, 0.45, 0.95], "none": [0.1]}
    best = {r["label_name"]: r["threshold"] for r in metrics.best_thresholds(preds(spark), grid).collect()}
    assert best["none"] == 0.5

    def f1(t):
        rows = [(y, p > t) for _, l, y, p in PREDS if l == "a"]
        tp = sum(y and h for y, h in rows)
        return 2 * tp / (2 * tp + sum(h and not y for y, h in rows) + sum(y and not h for y, h in rows))

    assert best["a"] == max(grid["a"], key=lambda t: (f1(t), -t))
    sizes = {k: len(v) for k, v in metrics.threshold_grid().items()}
    assert sizes == {"toxic": 8, "severe_toxic": 8, "obscene": 6, "threat": 4, "insult": 6, "identity_hate": 5}


def test_bins_are_right_closed(spark):
    df = preds(spark).filter("label_name = 'a'")
    counts = {r["confidence_level"]: r["n"] for r in analysis.confidence_counts(df).collect()}
    assert counts == {"Very Low": 1, "Low": 1, "Moderate": 2, "High": 0, "Very High": 3}


def test_running_sums_over_many_buckets(spark):
    rows = [("x", float(i % 997) + i / 1e6, 1) for i in range(3000)] + [("y", 1.0, 7)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    for rows_per_bucket in (10, 200, 10_000):
        out = running_sums(df, "g", "v", ["n"], rows_per_bucket).filter("g = 'x'").collect()
        assert [c for _, c in sorted((r["v"], r["cum_n"]) for r in out)] == list(range(1, 3001))
    buckets = range_buckets(df, "g", "v", 10).groupBy("g", "_bucket").count().filter("g = 'x'")
    assert buckets.count() > 250 and buckets.agg(F.max("count")).first()[0] < 60


def test_group_limit_is_pushed_before_the_shuffle(spark):
    out = top_k_per(preds(spark), ["label_name"], [F.col("p").desc()], 2)
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_coverage(spark):
    df = table(spark, ["a a a a a a a a b c"])
    freq = profile.word_frequencies(df)
    assert tuple(profile.coverage(freq).first()) == (3, 3)
    assert tuple(profile.coverage(freq, mode="true").first()) == (3, 2)


def test_sequences(spark):
    train = table(spark, ["b a a", "c b"])
    encoder = SequenceEncoder(4)
    with pytest.raises(ValueError):
        encoder.transform(train)
    ids = {r["word"]: r["word_id"] for r in word_index(train, 4).collect()}
    assert ids == {"b": 1, "a": 2, "c": 3}
    assert {r["word"] for r in word_index(train, 3).collect()} == {"a", "b"}
    rows = encoder.fit(train, 3).transform(table(spark, ["a b x c a", "x", None, ""])).orderBy("doc_id").collect()
    assert [r["sequence"] for r in rows] == [[1, 3, 2], [0, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_splits_do_not_depend_on_layout(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    one = splits.stratified_split(df.coalesce(1), "y").filter("is_test")
    many = splits.stratified_split(df.repartition(16), "y").filter("is_test")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert {r["y"]: r["count"] for r in one.groupBy("y").count().collect()} == {0: 360, 1: 40}
    share = splits.random_split(df).filter("is_test").count() / 2000
    assert 0.16 < share < 0.24


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    x[:, 4] = 2.0
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    corr = [r["correlation"] for r in vectors.label_correlation(df).orderBy("dimension").collect()]
    for d in range(4):
        assert corr[d] == pytest.approx(np.corrcoef(x[:, d], y)[0, 1])
    assert corr[4] is None or abs(corr[4]) < 1e-6
    gaps = np.abs(x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0))
    assert [r["dimension"] for r in vectors.top_gaps(df, 3).collect()] == list(np.argsort(gaps)[-3:])
    pcs = np.array([[r["pc1"], r["pc2"]] for r in vectors.principal_components(df).orderBy("vec_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(pcs), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_forest_learns_a_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = (x[:, 1] > 0.8).astype(int)
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    vec = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, embedding array<double>")
    lab = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id bigint, toxic int, threat int")
    run = embedding_forest.train(vec, lab, ["toxic", "threat"], settings=models.ForestSettings(trees=10, depth=4, min_leaf=1))
    summary = {r["label_name"]: r for r in run.summary().collect()}
    assert summary["toxic"]["roc_auc"] > 0.95
    assert summary["threat"]["roc_auc"] is None  # one class only
    top = models.top_importances(run.importances, 1).filter("label_name = 'toxic'").first()
    assert top["feature"] == "feature_1"


def test_scaling_uses_training_rows(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    (out,) = models.scale(df, [df], ["a", "b"])
    rows = out.orderBy("a").collect()
    assert rows[2]["a"] == pytest.approx(2 / math.sqrt(8 / 3)) and rows[0]["b"] == 0.0


def test_weights_are_balanced(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    assert {r["y"]: r["weight"] for r in metrics.class_weights(df, "y").collect()} == {0: 4 / 6, 1: 2.0}


def test_kept_vectors_are_not_computed_again(spark, tmp_path):
    def make_model():
        def predict(texts):
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

        return predict

    path = str(tmp_path / "v")
    df = table(spark, ["a", "bb", "ccc"])
    assert cached_vectors(df.limit(2), path, make_model).count() == 2
    out = cached_vectors(df, path, make_model)
    assert sorted((r["doc_id"], r["embedding"][0]) for r in out.collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert spark.read.parquet(path).count() == 3


def test_tables(spark, tmp_path):
    df = table(spark, [' lead "q", x\nline ', "", None], toxic=[1, 0, 0])
    path = str(tmp_path / "csv")
    src.write_csv(df, path)
    back = src.read_comments(spark, path, src.comment_schema(["toxic"])).orderBy("doc_id").collect()
    assert back[0]["text"] == ' lead "q", x\nline ' and back[0]["toxic"] == 1
    with pytest.raises(FileNotFoundError):
        src.load_processed(spark, str(tmp_path / "nothing"))
    assert src.new_columns(df.withColumn("z", F.lit(1)).withColumn("b", F.lit(1)), df) == ["b", "z"]
    assert src.shape(df) == (3, 3)
    assert [r["doc_id"] for r in src.preview(df, 2).collect()] == [0, 1]


def test_tagger_gets_no_blank_text(spark):
    def load():
        def tag(texts):
            assert all(t.strip() for t in texts)
            return [[(0, t, "VERB", 0, 0)] for t in texts]

        return tag

    rows = tag_texts(table(spark, ["Go", None, " "]), load, batch_size=1).orderBy("doc_id").collect()
    assert [len(r["tagged"]) for r in rows] == [1, 0, 0]
    assert rows[0]["tagged"][0]["pos"] == "VERB"


def test_engineered_columns(spark):
    out = engineered_features(table(spark, ["all black cats", ""]), "text", lx.IDENTITY_TERMS)
    assert {"capital_ratio", "has_exclamation", "us_vs_them_count", "tfidf_0", "tfidf_99"} <= set(out.columns)
    assert out.orderBy("doc_id").first()["targeted_hate_count"] == 1
    assert "targeted_hate_count" not in engineered_features(table(spark, ["a cat"]), "text").columns


def test_stream_scored_by_a_forest(spark, tmp_path):
    texts = ["you are a stupid idiot", "a kind day", "stupid trash", "nice work"] * 10
    df = table(spark, texts, toxic=[1, 0, 1, 0] * 10)
    train = enrich(df, stop_words=["a"])
    columns = ["aggressive_word_ratio", "word_count", "uppercase_ratio"]
    forest = RandomForestClassifier(labelCol="toxic", numTrees=5, seed=1)
    scorer = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(train)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.select("doc_id", "text").repartition(4).write.parquet(source)
    stream = read_stream(spark, source, df.select("doc_id", "text").schema, files_per_batch=2)
    scored = enrich(stream, stop_words=["a"], scorer=scorer).select("doc_id", "prediction")
    write_available(scored, sink, str(tmp_path / "progress")).awaitTermination()
    got = {r["doc_id"]: r["prediction"] for r in spark.read.parquet(sink).collect()}
    assert got == {i: float(y) for i, y in enumerate([1, 0, 1, 0] * 10)}
