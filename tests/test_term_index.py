"""Lexicons of user size: the same rows as term by term, at a cost that follows the text."""

import random

import pytest
from conftest import table

from modlens.operators import identity as op
from modlens.operators.term_index import TermIndex, categories, held_terms


def made_up(n, seed, low=1, high=9):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcde é", k=rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("q", [1, 2, 4])
def test_held_terms_are_those_of_a_plain_search(q):
    terms = made_up(600, 1) + ["", "zz", "日本語", "a"]
    index = TermIndex(terms, q)
    for text in [*made_up(80, 2, 0, 60), "", "日本語 zz", "a" * 50, "zzz", None]:
        assert index.held(text) == sorted({t for t in terms if t and t in (text or "")})


def test_a_text_meets_few_terms():
    rng = random.Random(3)
    terms = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(50_000)]
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(200)) + " " + terms[7]
    few, many = TermIndex(terms[:500]), TermIndex(terms)
    assert terms[7] in many.held(text) and many.held(text) == sorted({t for t in terms if t in text})
    # Candidates grow with shared grams, far below the lexicon.
    assert len(many.candidates(text)) < 500 and len(few.candidates(text)) < 30


LEXICON = {"one": [f"t{i:03d}" for i in range(300)] + ["man", "Wo"], "two": ["man", "é"], "none": []}


def test_counts_of_a_large_lexicon(spark, monkeypatch):
    texts = ["t001 t0012 woman man", "Woman t299t299", "", None, "mané é", "nothing"]
    df = table(spark, texts, toxic=[1, 0, 1, 1, 0, 1])
    large = sorted(map(tuple, op.term_statistics(df, lexicon=LEXICON).collect()))
    pairs = sorted(map(tuple, op.phrase_term_pairs(df, lexicon=LEXICON).collect()))
    labels = df.select("doc_id", "toxic")
    by_key = sorted(map(tuple, op.term_statistics(df.drop("toxic"), lexicon=LEXICON, labels=labels).collect()))
    monkeypatch.setattr(op, "INDEX_FROM", 10_000)
    assert large == by_key == sorted(map(tuple, op.term_statistics(df, lexicon=LEXICON).collect()))
    assert pairs == sorted(map(tuple, op.phrase_term_pairs(df, lexicon=LEXICON).collect()))
    assert ("one", "man", 4, 2, 0.5) in large and ("two", "man", 4, 2, 0.5) in large


def test_a_term_of_two_categories_counts_in_both(spark):
    df = table(spark, ["a man and a man"])
    got = categories(held_terms(df, "text", ["man"], ["doc_id"], counts=True), LEXICON).collect()
    assert sorted((r["category"], r["n"]) for r in got) == [("one", 2), ("two", 2)]
    assert held_terms(df.limit(0), "text", ["man"], ["doc_id"]).count() == 0
    assert held_terms(df, "text", [], ["doc_id"]).count() == 0
