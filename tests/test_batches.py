"""Steps on every word of a corpus run over whole Arrow batches and give the rows of the plain ones."""

import random
from collections import Counter

import pyarrow as pa
from conftest import table
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import features as ft
from modlens.functions import text as tx
from modlens.operators import term_batches, tfidf
from modlens.sources.taggers import tag_texts

T = F.col("text")


def mixed_texts(n=300, seed=11):
    rng = random.Random(seed)
    keys = [k for entries in lx.SUBSTITUTION_PASSES for k, _ in entries if k.isascii()]
    bits = [*keys, "word", "u$", "$$", "_", "7", ".", "'", "/", " ", " ", " ", "\n", "\t", "  ", "can", "NOT"]
    return ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(n)] + [None, "", " "]


def test_shorthand_of_ascii_texts_is_that_of_all_texts(spark):
    df = table(spark, mixed_texts())
    pair = df.select(tx.expand_ascii(T).alias("a"), tx.expand_all(T).alias("b"))
    assert pair.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_earlier_entries_win_and_odd_values_take_the_plain_way(spark):
    df = table(spark, ["b.c b x", "a(b)", "é b", None])
    for entries in ([("b", "1"), ("b.c", "2"), ("(b", "3")], [("b.c", "2"), ("b", "é"), ("a(", "4")], [("é", "e")], []):
        pair = df.select(*[f(F.regexp_replace(T, "é", ""), [entries]) for f in (tx.expand_ascii, tx.expand_all)])
        assert all(r[0] == r[1] for r in pair.collect())


def test_cleaning_reads_a_text_once_for_all_keys(spark):
    plan = table(spark, ["idk"]).select(tx.clean(T))._jdf.queryExecution().optimizedPlan().toString()
    # The JVM's search tries the keys one by one at every word.
    assert "ArrowEvalPython" in plan and "ratchet" not in plan and "armageddon" not in plan


def test_terms_of_batches_are_those_of_the_column_expression(spark):
    texts = [*mixed_texts(60), "Naïve élan É é naïve élan", "a bb ccc", "日本 x_y 9 99 x_y", "ée é", "ſß bb·cc", "bb"]
    want = Counter()
    for r in table(spark, texts).select(F.array_compact(tfidf.terms(T)).alias("t")).collect():
        want.update(r["t"] or [])
    got = tfidf.vocabulary(table(spark, texts).repartition(3), max_features=10**4).collect()
    assert {r["term"]: r["total"] for r in got} == want and len(got) == len(want)


def test_steps_cut_a_batch_without_loss(monkeypatch):
    texts = [f"word{n} bb" for n in range(50)] + [None, ""]
    whole = term_batches.Terms(next(term_batches.steps(pa.array(texts))))
    monkeypatch.setattr(term_batches, "STEP", 40)
    parts = list(term_batches.steps(pa.array(texts)))
    assert len(parts) > 5 and sum(map(len, parts)) == 52
    assert sum(len(term_batches.Terms(p).word) for p in parts) == len(whole.word) == 100


def test_no_term_of_a_text_is_made_outside_batches(spark, folder):
    docs = table(spark, ["a common word", "common word order"])
    plan = tfidf.fit_tfidf(docs, max_features=5).weights(docs)._jdf.queryExecution().optimizedPlan().toString()
    # The JVM made, sorted and compared every bigram one by one.
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_tokens_of_ascii_texts_are_those_of_all_texts(spark):
    odd = ["Mr. Dr.x St.'s", "n't nn't n'tx 'n't", "can't cannot CANNOT. I'm she's'll 'D", "a\x0bb\x0cc\r\n", "''s Ms.. _n't"]
    df = table(spark, [*odd, *mixed_texts(300, seed=5)])
    pair = df.select(tx.tokens_ascii(T).alias("a"), tx.tokens(T).alias("b"))
    assert pair.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_tagged_tokens_leave_python_as_columns(spark):
    def load():
        return lambda texts: [[(n, w, None, n // 2, None) for n, w in enumerate(t.split())] for t in texts]

    rows = tag_texts(table(spark, ["a b c", None, "", "d"]).coalesce(1), load, batch_size=2).orderBy("doc_id").collect()
    assert [[tuple(t) for t in r["tagged"]] for r in rows] == [
        [(0, "a", None, 0, None), (1, "b", None, 0, None), (2, "c", None, 1, None)], [], [], [(0, "d", None, 0, None)],
    ]
    df = tag_texts(table(spark, ["a"]), load)
    # Rows of dicts cost far more than the tagger.
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


def test_no_tag_is_counted_token_by_token(spark):
    df = spark.createDataFrame([], f"doc_id int, t {ft.TAGGED_TYPE}")
    plan = df.select(ft.syntax_features(F.col("t"))["verb_ratio"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
