"""Text features: lexicon, pattern, shape and emotion columns, and features of tagged tokens."""

from __future__ import annotations

import functools
import operator
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import text as tx
from modlens.functions.arrays import array_total, let, with_fields

TAGGED_TYPE = "array<struct<i:int,text:string,pos:string,head:int,sent:int>>"
PUNCTUATION = string.punctuation
UPPERCASE = r"\p{Lu}"

NATIVE_FEATURES = [
    "word_count", "avg_word_length", "sentence_count", "uppercase_ratio", "punctuation_ratio",
    "hate_pattern_count", "aggressive_word_ratio", "stereotype_pattern_count",
    "generalization_ratio", "anger_ratio", "disgust_ratio", "fear_ratio", "joy_ratio",
    "sadness_ratio",
]
TAGGED_FEATURES = [
    "personal_attack_score", "verb_ratio", "adj_ratio", "adv_ratio", "pronoun_ratio",
    "imperative_count",
]
COUNT_FEATURES = {
    "word_count", "sentence_count", "hate_pattern_count", "stereotype_pattern_count",
    "imperative_count",
}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def hate_pattern() -> str:
    """Hate phrases, or a trigger followed later in the same run of words by a target.

    A run is a stretch of words with one blank between them. The pattern takes a run from the
    first trigger to its end, which counts the same as a greedy search for the last target, and
    uses possessive groups only, so a run of many thousand words needs no deep stack.
    """
    trigger = tx.any_of(lx.HATE_TRIGGERS)
    target = tx.any_of(lx.HATE_TARGETS)
    # The rest of a run is eaten up to a "can" that may begin the next trigger.
    apart = r"(?!\w*can't)"
    chain = rf"(?:(?!{target})\w++ )*+"
    rest = rf"(?:{apart}\w*+(?: {apart}\w++)*+)?+"
    return rf"(?:{trigger}) {chain}(?:{target}){rest}"


def _where_any(low: Column, marks: Sequence[str], count: Column) -> Column:
    # A pattern is searched only where the text holds one of its words.
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(low, F.lit(m))
    return F.when(held, count).otherwise(F.lit(0))


def hate_pattern_count(low: Column) -> Column:
    """Matches of the hate patterns in lower-cased text."""
    total = _where_any(low, lx.HATE_TRIGGERS, tx.count_matches(low, hate_pattern()))
    for phrase in lx.HATE_PHRASES:
        total = total + tx.count_literal(low, F.lit(phrase))
    return total


def stereotype_pattern_count(low: Column) -> Column:
    """Matches of the stereotype patterns in lower-cased text."""
    total = F.lit(0)
    for p in lx.STEREOTYPE_PATTERNS:
        if "(" not in p:
            total = total + tx.count_literal(low, F.lit(p))
        else:
            total = total + tx.count_matches(low, p)
    return total


def bias_pattern_counts(text: Column, terms: Sequence[str]) -> dict[str, Column]:
    """The four bias pattern counts of lower-cased text, and two columns that are always 0."""
    low = F.lower(text)
    alternation = "|".join(tx.quote(t) for t in terms)
    out = {
        f"{name}_count": tx.count_matches(low, pattern.replace("{terms}", alternation)).cast("int")
        for name, pattern in lx.BIAS_PATTERNS.items()
    }
    out["identity_followed_by_negative"] = F.lit(0)
    out["identity_preceded_by_all"] = F.lit(0)
    return out


def linguistic_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Sentence count, mean token length, capital share, question and exclamation flags."""
    text = F.col(text_col)

    def of_tokens(toks: Column) -> Column:
        return F.struct(
            mean_length(toks).alias("avg_word_length"),
            F.array_contains(toks, "?").alias("has_question"),
            F.array_contains(toks, "!").alias("has_exclamation"),
        )

    out = with_fields(
        df,
        {
            "sentence_count": tx.sentence_count(text),
            "capital_ratio": tx.char_ratio(text, UPPERCASE),
            "_s": let(tx.tokens(text), of_tokens),
        },
    )
    return out.select("*", "_s.*").drop("_s")


def mean_length(tokens_col: Column) -> Column:
    """Mean token length, 0 when there are no tokens."""
    return ratio(F.length(F.array_join(tokens_col, "")), F.size(tokens_col))


def native_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All text features that need no tagger, in one pass; zeros for NULL or blank text.

    Tokens are made once. Tokens in any of the lists are filtered once, and each list counts
    over that short rest.
    """
    listed = {
        "aggressive_word_ratio": lx.AGGRESSIVE_WORDS,
        "generalization_ratio": lx.GENERALIZING_WORDS,
        **{f"{name}_ratio": ws for name, ws in lx.EMOTION_WORDS.items()},
    }
    every = sorted({w for ws in listed.values() for w in ws})

    def of_tokens(toks: Column) -> Column:
        hits = F.filter(F.transform(toks, F.lower), lambda t: t.isin(every))
        return F.struct(
            F.size(toks).alias("n"), mean_length(toks).alias("mean"), hits.alias("hits")
        )

    def of_text(text: Column, low: Column, s: Column) -> dict[str, Column]:
        out = {
            "word_count": s["n"],
            "avg_word_length": s["mean"],
            "sentence_count": tx.sentence_count(text),
            "uppercase_ratio": tx.char_ratio(text, UPPERCASE),
            "punctuation_ratio": tx.char_set_ratio(text, PUNCTUATION),
            "hate_pattern_count": hate_pattern_count(low).cast("int"),
            "stereotype_pattern_count": stereotype_pattern_count(low).cast("int"),
        }
        for name, ws in listed.items():
            out[name] = ratio(tx.count_in(s["hits"], ws), s["n"])
        return out

    text = F.when(tx.is_blank(F.col(text_col)), F.lit("")).otherwise(F.col(text_col))
    base = df.withColumn("_txt", text).withColumn("_low", F.lower("_txt"))
    base = with_fields(base, {"_s": let(tx.tokens(F.col("_txt")), of_tokens)})
    cols = of_text(F.col("_txt"), F.col("_low"), F.col("_s"))
    return with_fields(base, {n: cols[n] for n in NATIVE_FEATURES}).drop("_txt", "_low", "_s")


def near_attack_ratio(text: Column, window: int = 3) -> Column:
    """Second-person tokens with an aggressive word within some tokens, per token.

    Stands in for the personal-attack score where no tagger is at hand.
    """
    def body(toks: Column) -> Column:
        marks = F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        bad = F.transform(
            F.filter(marks, lambda m: m["t"].isin(lx.AGGRESSIVE_WORDS)), lambda m: m["i"]
        )
        you = F.filter(marks, lambda m: m["t"].isin(lx.SECOND_PERSON_WORDS))

        def near(b: Column) -> Column:
            covered = F.array_distinct(
                F.flatten(F.transform(b, lambda i: F.sequence(i - window, i + window)))
            )
            # Only positions that hold a second-person word count.
            return F.size(F.array_intersect(F.transform(you, lambda m: m["i"]), covered))

        return ratio(F.when(F.size(bad) > 0, let(bad, near)).otherwise(F.lit(0)), F.size(toks))

    return let(tx.tokens(F.lower(text)), body)


# -- features of tagged tokens --------------------------------------------------------------


def tag_count(toks: Column, pos: str) -> Column:
    """Number of tokens with a part-of-speech tag."""
    # No lambda: array functions run compiled over the whole array.
    return F.size(toks["pos"]) - F.size(F.array_remove(toks["pos"], pos))


def dependency_distance(toks: Column) -> Column:
    """Mean distance of the tokens to their heads, roots left out; 0 if there are none."""
    # A root's distance is 0.
    far = F.transform(toks, lambda t: F.coalesce(F.abs(t["i"] - t["head"]), F.lit(0)))
    return let(far, lambda d: ratio(array_total(d), F.size(F.array_remove(d, 0))))


def personal_attack_score(toks: Column) -> Column:
    """Second-person tokens with an aggressive dependent, per token."""
    attackers = F.filter(
        toks, lambda c: (c["head"] != c["i"]) & F.lower(c["text"]).isin(lx.AGGRESSIVE_WORDS)
    )
    you = F.filter(toks, lambda t: F.lower(t["text"]).isin(lx.SECOND_PERSON_WORDS))
    hit = F.size(F.array_intersect(you["i"], attackers["head"]))
    # Tokens are looked at one by one only where the text holds words of both kinds at all.
    both = let(
        F.lower(F.array_join(toks["text"], " ")),
        lambda low: _holds(low, lx.SECOND_PERSON_WORDS) & _holds(low, lx.AGGRESSIVE_WORDS),
    )
    return ratio(F.when(both, hit).otherwise(F.lit(0)), F.size(toks))


def _holds(text: Column, words: Sequence[str]) -> Column:
    # A word that holds another one of the list need not be searched for.
    least = [w for w in words if not any(v != w and v in w for v in words)]
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in least])


def imperative_count(toks: Column) -> Column:
    """Number of sentences whose first token is a verb."""
    # A sentence begins where its number differs from that of the token before; verbs are few.
    starts = F.filter(
        toks, lambda t, i: (t["pos"] == "VERB") & ~t["sent"].eqNullSafe(F.get(toks, i - 1)["sent"])
    )
    return F.size(starts)


def pos_counts(toks: Column) -> dict[str, Column]:
    """Verb, adjective and pronoun counts and the mean dependency distance."""
    return {
        "verb_count": tag_count(toks, "VERB"),
        "adj_count": tag_count(toks, "ADJ"),
        "pronoun_count": tag_count(toks, "PRON"),
        "dependency_distance": dependency_distance(toks),
    }


def syntax_features(toks: Column) -> dict[str, Column]:
    """Tag shares, imperative sentences and the personal-attack score; zeros without tokens."""
    t = F.coalesce(toks, F.array().cast(TAGGED_TYPE))
    n = F.size(t)
    return {
        "personal_attack_score": personal_attack_score(t),
        "verb_ratio": ratio(tag_count(t, "VERB"), n),
        "adj_ratio": ratio(tag_count(t, "ADJ"), n),
        "adv_ratio": ratio(tag_count(t, "ADV"), n),
        "pronoun_ratio": ratio(tag_count(t, "PRON"), n),
        "imperative_count": imperative_count(t),
    }


def combined_features(
    df: DataFrame, text_col: str = "text", tagged_col: str | None = None
) -> DataFrame:
    """The frame with all twenty text features; tag features are 0 without a tagged column."""
    return tagged_features(native_features(df, text_col), tagged_col)


def tagged_features(df: DataFrame, tagged_col: str | None = None) -> DataFrame:
    """The frame with the features of a tagged column, 0 without one."""
    if tagged_col is None:
        zeros = {c: F.lit(0 if c in COUNT_FEATURES else 0.0) for c in TAGGED_FEATURES}
        return df.withColumns(zeros)
    return df.withColumns(syntax_features(F.col(tagged_col)))
