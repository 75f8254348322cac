import re

from conftest import table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import features as ft
from modlens.functions import identity as idf
from modlens.functions import negation as ng
from modlens.functions.arrays import running_totals
from modlens.operators import identity as op
from modlens.operators.normalise import normalise, toxic_with_identity

T = F.col("text")
SMALL = {
    "gender": ["woman", "man", "transgender", "gay"],
    "religion": ["muslim", "christian", "jew"],
}
TERMS = lx.distinct_terms(SMALL)
ONE = "I hate how gay people always make everything about being gay. They should just keep quiet."
TWO = "Mr. Smith is a great teacher. He's not discriminating against any students."


def test_known_outputs(spark):
    out = normalise(table(spark, [ONE, TWO, None, ""]), lexicon=SMALL).orderBy("doc_id").collect()
    counts = [tuple(r[c] for c in ng.POLARITY_COLUMNS) for r in out]
    assert out[0]["normalized_text"] == (
        "I hate how gay people always make everything about being gay . They should just keep quiet ."
    )
    assert out[1]["normalized_text"] == (
        "Mr. Smith is a great teacher . He 's not NOT_discriminating against any students ."
    )
    assert counts == [(0, 0, 0, 1), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert [r["normalized_text"] for r in out[2:]] == ["", ""]


STOPS = ["the", "of", "it"]
KINDS = {"N": "not", "T": "but", "I": "gay", "M": "word", "U": "of"}


def marked(kinds):
    """One pass over token kinds: how many tokens of the scope are used up, and the marks."""
    used, out = None, []
    for k in kinds:
        word = KINDS[k]
        if k == "N":
            used = 0
        elif k == "T":
            used = None
        elif k != "I" and used is not None:
            if k == "M":
                word = "NOT_" + word
            used += 2 if k == "M" else 1
            if used >= 3:
                used = None
        out.append(word)
    return " ".join(out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="NTIMU", max_size=12), min_size=80, max_size=120))
def test_scope_equals_a_walk(spark, sequences):
    texts = [" ".join(KINDS[k] for k in s) for s in sequences]
    df = table(spark, texts).select("doc_id", ng.mark_negation(T, TERMS, STOPS).alias("v"))
    assert [r["v"] for r in df.orderBy("doc_id").collect()] == [marked(s) for s in sequences]


def test_long_runs_do_not_overflow(spark):
    texts = ["not " + "gay " * 30_000 + "word", "hate " + "word " * 30_000 + "people"]
    df = table(spark, texts).select(
        ng.mark_negation(T, TERMS, STOPS).alias("v"), ft.hate_pattern_count(T).alias("n")
    )
    rows = df.collect()
    assert rows[0]["v"].endswith("gay NOT_word")
    assert rows[1]["n"] == 1


def test_case_option(spark):
    df = table(spark, ["He is NOT Very GAY But Fine"])
    marked_ = df.select(ng.mark_negation(T, TERMS, STOPS, preserve_case=False)).first()[0]
    assert marked_ == "he is NOT NOT_very GAY But fine"


def test_polarity_rules(spark):
    texts = [
        "many good things. not a woman, bad",      # "man" inside "many" and "woman"
        "nice middle eastern food! no middle  eastern",
        "He didn't like gay art",                   # no negation on a phrase
    ]
    terms = ["man", "woman", "middle eastern", "gay"]
    rows = table(spark, texts).select("doc_id", ng.polarity(T, terms).alias("p")).orderBy("doc_id")
    got = [tuple(r["p"]) for r in rows.collect()]
    # negations, identity in negation, positive, negative
    assert got == [(1, 2, 1, 2), (1, 0, 1, 0), (0, 0, 0, 0)]


def mentions_of(text, terms, window=5):
    out = []
    for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", text.lower()):
        words, ix = text.split(), len(text[: m.start()].split())
        out.append((m.group(), m.start(), " ".join(words[max(0, ix - window) : ix + window + 1])))
    return out


PARTS = ["man", "woman", "middle eastern", "middle", "Gay", "non-", "x", "many", " ", "  ", "\n", ".", "é"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=40, max_size=60))
def test_mentions_equal_a_search(spark, texts):
    lexicon = {"a": ["man", "middle eastern"], "b": ["gay", "woman", "man"]}
    df = table(spark, texts).select("doc_id", idf.mentions(T, lexicon).alias("m")).orderBy("doc_id")
    for row, text in zip(df.collect(), texts):
        want = [(c, *m) for c, terms in lexicon.items() for m in mentions_of(text, terms)]
        assert [tuple(m)[:4] for m in row["m"]] == want


def test_overlapping_terms_are_searched_apart(spark):
    lexicon = {"a": ["middle eastern", "eastern man"], "b": ["middle"]}
    assert not idf.separable(t for ts in lexicon.values() for t in ts)
    text = "middle eastern man"
    row = table(spark, [text]).select(idf.mentions(T, lexicon).alias("m")).first()
    assert [(m["category"], m["term"]) for m in row["m"]] == [("a", "middle eastern"), ("b", "middle")]
    counts = op.identity_columns(table(spark, [text]), lexicon=lexicon).first()
    assert (counts["a_mentions"], counts["b_mentions"]) == (1, 1)


def test_identity_columns(spark):
    df = table(spark, ["A Muslim man. MAN!", "many women", None], toxic=[1, 0, 1])
    out = op.identity_columns(df).orderBy("doc_id").collect()
    assert [r["identity_term_count"] for r in out] == [4, 0, 0]  # muslim is in two categories
    assert [r["gender_mentions"] for r in out] == [2, 0, 0]
    assert toxic_with_identity(op.identity_columns(df)).count() == 1
    nested = op.nested_mentions(df.limit(1)).first()["identity_mentions"]
    assert sorted(nested) == ["gender", "race_ethnicity", "religion"]


def test_term_statistics(spark):
    df = table(spark, ["woman man", "Man many", "old"], toxic=[1, 0, 0])
    stats = {r["term"]: r for r in op.term_statistics(df, lexicon=SMALL).collect()}
    assert (stats["man"]["total_mentions"], stats["man"]["toxic_mentions"]) == (3, 2)
    assert stats["jew"]["toxic_ratio"] == 0.0
    words = {r["term"]: r for r in op.term_statistics(df, lexicon=SMALL, word_boundary=True).collect()}
    assert words["man"]["total_mentions"] == 2


def test_running_totals(spark):
    values = [(i * 37) % 11 for i in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([5],)], "v array<int>")
    got = [r["s"] for r in df.select(running_totals(F.col("v")).alias("s")).collect()]
    want, total = [], 0
    for v in values:
        total += v
        want.append(total)
    assert got == [want, [], [5]]


HATE = ["hate", "whate", "despise", "can't stand", "can", "'", "people", "peoples", "groupcan't", "group", "x", "."]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*HATE, " ", " ", " "]), max_size=20).map("".join), min_size=80, max_size=120))
def test_hate_pattern_equals_greedy_search(spark, texts):
    plain = r"(?:hate|despise|can't stand) (?:\w+ )*(?:people|group|community)"
    df = table(spark, texts).select("doc_id", ft.hate_pattern_count(T).alias("n")).orderBy("doc_id")
    want = [
        len(re.findall(plain, t)) + sum(t.count(p) for p in lx.HATE_PHRASES) for t in texts
    ]
    assert [r["n"] for r in df.collect()] == want
