import re

import pytest
from conftest import table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import text as tx

T = F.col("text")


def values(spark, texts, expr):
    rows = table(spark, texts).select("doc_id", expr.alias("v")).orderBy("doc_id").collect()
    return [r["v"] for r in rows]


def test_links(spark):
    texts = [
        "start https://a.example/p?q=2 end", "word_http://b.example tail", "line one\nwww.c.example line two",
        "www alone", None, "",
    ]
    assert values(spark, texts, tx.remove_urls(T)) == [
        "start  end", "word_ tail", "line one\n line two", "www alone", None, "",
    ]
    assert values(spark, texts, tx.has_url(T)) == [True, True, False, False, None, False]
    both = tx.has_url(T, ("http", "www"))
    assert values(spark, texts, both) == [True, True, True, True, None, False]


def test_addresses(spark):
    texts = ["me@x.org hi", "hi me@x.org", "ME@X.ORG", "a@b.c9x@d.e", "x" * 50_000, None]
    assert values(spark, texts, tx.starts_with_email(T)) == [True, False, False, True, False, None]
    assert values(spark, texts, tx.remove_emails(T)) == [" hi", "hi ", "ME@X.ORG", "", "x" * 50_000, None]


def test_printable(spark):
    assert values(spark, ["café\t€5\n☺", None], tx.keep_printable(T)) == ["caf\t5\n", None]


def replaced(text, passes):
    for entries in passes:
        table_ = dict(entries)
        keys = "|".join(re.escape(k) for k in table_)
        text = re.sub(rf"(?<!\w)(?:{keys})(?!\w)", lambda m: table_[m.group()], text)
    return text


def test_shorthand_examples(spark):
    texts = [
        "omw 2mw w/ bae l8r <3", "w/o w/e w/", "encl. ft. ft", "$5 a$ $ $u", "tl;dr;tbh", "LOL lol lols",
        "_u u_ u", None, "",
    ]
    want = [None if t is None else replaced(t, lx.SUBSTITUTION_PASSES) for t in texts]
    assert values(spark, texts, tx.expand_all(T)) == want
    assert want[0] == "on my way tomorrow with before anyone else later love"
    assert want[3].startswith("$5 a$")


PIECES = [k for p in lx.SUBSTITUTION_PASSES for k, _ in p] + list(" \n.$w/e<3u_é☺") + ["ft", "enclx"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=40, max_size=80))
def test_shorthand_equals_one_substitution(spark, texts):
    assert values(spark, texts, tx.expand_all(T)) == [replaced(t, lx.SUBSTITUTION_PASSES) for t in texts]


@pytest.mark.parametrize(
    "entries",
    [
        [("a.b", "1"), ("a", "2"), ("a.c", "3")],
        [("a", "1"), ("a.b", "2")],
        [("a+", "1"), ("a", "2"), ("+", "3"), ("++", "4")],
        [("x y", "1"), ("x", "2"), ("y", "3")],
    ],
)
def test_earlier_entry_wins(spark, entries):
    texts = ["a.b a.c a", "a+ a++ + ++ a+b", "x y x  y yx", "a.b.c+a"]
    assert values(spark, texts, tx.expand_shorthand(T, entries)) == [replaced(t, [entries]) for t in texts]


def test_tokens(spark):
    text = "Mr. Smith can't, won't; cannot! He's DON'T x_y 3.5 n't"
    assert values(spark, [text], tx.tokens(T))[0] == [
        "Mr.", "Smith", "ca", "n't", ",", "wo", "n't", ";", "can", "not", "!", "He", "'s", "DO", "N'T",
        "x_y", "3", ".", "5", "n't",
    ]


def test_sentences(spark):
    texts = ["One. Two! \"Three?\" four", "Mr. X came.  Dr. Y left.\nWho?", "  ", "", ". . .", "a.b c", None]
    got = values(spark, texts, tx.sentences(T))
    assert got[0] == ["One.", "Two!", '"Three?"', "four"]
    assert got[1] == ["Mr. X came.", "Dr. Y left.", "Who?"]
    counts = values(spark, texts, tx.sentence_count(T))
    assert counts == [4, 3, 0, 0, 3, 1, None]
    assert counts[:-1] == [len(s) for s in got[:-1]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aM r.D!?\"') \n", max_size=25), min_size=60, max_size=90))
def test_sentence_count_equals_sentences(spark, texts):
    got = table(spark, texts).select(tx.sentence_count(T).alias("n"), F.size(tx.sentences(T)).alias("m"))
    assert all(r["n"] == r["m"] for r in got.collect())


def test_splits(spark):
    assert values(spark, [" a  b\tc\n"], tx.words(T)) == [["a", "b", "c"]]
    assert values(spark, [" a  b\tc\n", ""], tx.word_total(T)) == [3, 0]
    assert values(spark, ["a. .b!? c"], tx.phrases(T)) == [["a", "b", " c"]]
    assert values(spark, ["It's GOOD, (very)-good\tday"], tx.corpus_words(T)) == [
        ["it's", "good", "very", "good", "day"]
    ]
    assert values(spark, ["a b c", "a", ""], tx.ngrams(tx.words(T))) == [
        ["a", "b", "c", "a b", "b c"], ["a"], [],
    ]


def test_counts_and_ratios(spark):
    assert values(spark, ["manman woman"], tx.count_literal(T, F.lit("man"))) == [3]
    assert values(spark, ["AbC.", ""], tx.char_ratio(T, "A-Z")) == [0.5, 0.0]
    assert values(spark, ["AbC.", ""], tx.char_set_ratio(T, ".!")) == [0.25, 0.0]
    assert values(spark, [None, "", " \n", "x"], tx.is_blank(T)) == [True, True, True, False]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.sampled_from(["ab", "a", "abc", "b.c", "b", "ca", "c+"]), min_size=1, max_size=5, unique=True),
    st.lists(st.text(alphabet="abc.+ ", max_size=12), min_size=40, max_size=60),
)
def test_whole_word_equals_plain_alternation(spark, terms, texts):
    plain = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    want = [len(re.findall(rf"(?<!\w)(?:{plain})(?!\w)", t)) for t in texts]
    assert values(spark, texts, tx.count_matches(T, tx.whole_word(terms))) == want
