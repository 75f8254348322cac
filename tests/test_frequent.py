"""The most frequent terms through slot sums, against plain counts."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from modlens.operators import frequent, tfidf


def corpus(n=400, seed=3):
    """Rows (term, tf) of documents whose words follow a steep law."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        words = [f"w{w}" for w in np.minimum(rng.zipf(1.3, 120), 10**6)]
        rows += list(Counter(words).items())
    return rows


def plain(rows, k):
    total, df = defaultdict(int), Counter()
    for term, tf in rows:
        total[term] += tf
        df[term] += 1
    return [(t, total[t], df[t]) for t in sorted(total, key=lambda t: (-total[t], t))[:k]]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "term string, tf int").repartition(6)


@pytest.mark.parametrize("k", [1, 20, 150])
def test_terms_are_those_of_plain_counts(spark, k):
    rows = corpus()
    assert [tuple(r) for r in frequent.frequent_terms(pairs(spark, rows), k).collect()] == plain(rows, k)


@pytest.mark.parametrize("slots", [8, 16, 64])
def test_a_floor_that_proves_too_high_counts_all_terms(spark, slots, monkeypatch):
    rows = corpus(100)
    counted = []
    whole = frequent.term_counts
    monkeypatch.setattr(frequent, "term_counts", lambda df: counted.append(df) or whole(df))
    got = frequent.frequent_terms(pairs(spark, rows), 8, slots=slots)
    assert [tuple(r) for r in got.collect()] == plain(rows, 8)
    if slots == 8:
        # Every slot is far above the terms in it.
        assert len(counted) == 2


def test_few_terms_reach_the_second_pass(spark):
    rows = corpus()
    df = pairs(spark, rows)
    slots = frequent.slot_rows(20)
    sums = frequent.slot_sums(df, slots)
    assert sums.count() <= 2 * slots
    floor = plain(rows, 20)[-1][1]
    left = {r["term"] for r in frequent.reaching(df, sums, slots, floor).select("term").distinct().collect()}
    every = {t for t, _ in rows}
    assert {t for t, _, _ in plain(rows, 20)} <= left and len(left) < len(every) / 20


def test_ties_few_terms_and_no_rows(spark):
    same = [(f"t{n:03d}", 5) for n in range(60)]
    assert [r["term"] for r in frequent.frequent_terms(pairs(spark, same), 7).collect()] == [f"t{n:03d}" for n in range(7)]
    assert frequent.frequent_terms(pairs(spark, same), 100).count() == 60
    assert frequent.frequent_terms(pairs(spark, same).limit(0), 5).count() == 0


def test_vocabulary_of_texts(spark):
    texts = [("a common word and a common phrase",), ("common word order",), (None,), ("",), ("rare",)]
    df = spark.createDataFrame(texts, "text string")
    got = [tuple(r) for r in tfidf.vocabulary(df, max_features=3).collect()]
    assert got == [("common", 3, 2), ("word", 2, 2), ("common word", 2, 2)] or got == [
        ("common", 3, 2), ("common word", 2, 2), ("word", 2, 2)
    ]
    assert got[1][0] < got[2][0]
