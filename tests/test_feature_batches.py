"""Features and scores made in batches equal those made row by row."""

import random

from conftest import table
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions.features import combined_features
from modlens.operators import feature_batches, models
from modlens.operators.identity import identity_columns
from modlens.operators.normalise import clean_comments, normalise
from modlens.plans.manual_forest import feature_table

PIECES = (
    "cannot Cannot can't don't n't 'n't N'T xn't mn't woman't man woman superman Mr. Mr xMr. _Mr. Prof. 's 're 'm 'mn't 'ren't "
    "' . ! ? , ; : ( ) \" _ NOT_x not no never nothing but the I and good love bad hate despise people community always every "
    "stupid idiot happy angry gay Muslim jewish old teenage male female St. aint foo A - € é cannotn't cann't 'd 'll ... ?! $ t 't idk"
).split(" ") + ["\n", "\t", "  ", "middle eastern", "Middle Eastern", "go back to", "you people", "these people", "always x people", "a@b.co",
                "all of them are", "http://a.b c", "n'tN'T"]


def by_rows(df, lexicon=lx.IDENTITY_TERMS, stops=None):
    out = normalise(identity_columns(clean_comments(df), "text", lexicon), "text", lexicon, stops)
    return combined_features(out, "normalized_text")


def texts(n):
    rng = random.Random(5)
    ends = [" ", " ", "", "\n", "  "]
    made = ["".join(rng.choice(PIECES) + rng.choice(ends) for _ in range(rng.choice([0, 1, 2, 5, 20, 50]))) for _ in range(n)]
    return [*made, None, "", " \n", "€"]


def test_features_of_batches_are_those_of_rows(spark, monkeypatch):
    df = table(spark, texts(1500)).repartition(4).cache()
    # Slices of few bytes, so that texts stand first and last in them.
    monkeypatch.setattr(feature_batches, "STEP", 2000)
    other = {"a": ["man", "Woman", "good"], "b": ["super", "middle eastern", "old people"]}
    for lexicon, stops in ((lx.IDENTITY_TERMS, None), (other, ["a", "the", "foo", "x"])):
        assert feature_batches.fits(lexicon)
        want, got = by_rows(df, lexicon, stops), feature_table(df, lexicon=lexicon, stop_words=stops)
        assert want.dtypes == got.dtypes
        plain = {r["doc_id"]: r for r in want.collect()}
        assert all(plain.pop(r["doc_id"]) == r for r in got.collect()) and not plain


def test_terms_that_tokens_do_not_keep_are_searched_row_by_row(spark):
    for terms in (["can"], ["non-black"], ["café"], ["old man", "man"]):
        assert not feature_batches.fits({"a": terms})
    df = table(spark, ["Can I? You can't.", None])
    assert [r["a_mentions"] for r in feature_table(df, lexicon={"a": ["can"]}).orderBy("doc_id").collect()] == [2, 0]


def test_features_are_made_once_and_in_batches(spark):
    # Cleaning is one pass of batches, all features are another; no pattern is left to rows.
    df = feature_table(table(spark, ["He isn't old."])).select("doc_id", *lx.FEATURE_COLUMNS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "regexp_extract_all" not in plan


def by_spark(forests, df):
    rows = []
    for label, model in forests.items():
        names = {model.predictionCol: f"_hat_{label}", model.probabilityCol: f"_prob_{label}", model.rawPredictionCol: f"_raw_{label}"}
        df = model.copy(names).transform(df)
        p = vector_to_array(F.col(f"_prob_{label}"))
        rows.append(F.struct(
            F.lit(label).alias("label_name"), (p[1] if model.numClasses > 1 else F.lit(0.0)).alias("p"),
            F.col(f"_hat_{label}").cast("int").alias("yhat"),
        ))
    return df.select("doc_id", F.inline(F.array(*rows)))


def test_scores_of_batches_are_those_of_spark_to_the_last_bit(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), *[((F.col("id") * k) % 997 / 7).alias(f"f{k}") for k in (31, 77, 311)],
        (F.col("id") * 7919 % 101 > 60).cast("int").alias("y"), F.lit(0).alias("none"),
    )
    data = models.assemble(df, ["f31", "f77", "f311"])
    forests = {
        "y": models.fit_forest(data, "y", models.ForestSettings(25, 9, 2)), "none": models.fit_forest(data, "none"),
        "flat": models.fit_forest(data, "y", models.ForestSettings(3, 0, 1)),
    }
    # Inputs beyond all cuts too.
    beyond = F.element_at(F.array(*[F.lit(v) for v in (1e9, -1e9, -0.0)]), (F.col("doc_id") % 3 + 1).cast("int"))
    far = models.assemble(df.filter("doc_id < 30").withColumns({"f77": beyond, "doc_id": F.col("doc_id") + 9000}), ["f31", "f77", "f311"])
    rows = data.unionByName(far)
    got, want = models.score(forests, rows), by_spark(forests, rows)
    assert got.drop("y").exceptAll(want).isEmpty() and got.count() == 9090
    assert got.filter("label_name = 'y' AND y IS NULL").isEmpty()
    plan = models.score(forests, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
