"""Negation scope and polarity counts inside one text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import text as tx
from modlens.functions.arrays import array_total, let, string_array

POLARITY_COLUMNS = [
    "negation_count", "identity_in_negation", "identity_positive_context",
    "identity_negative_context",
]


def default_stop_words() -> list[str]:
    """Spark ML's English stop words."""
    return [w.lower() for w in StopWordsRemover.loadDefaultStopWords("english")]


def content_stop_words(stop_words: Sequence[str], terms: Sequence[str]) -> list[str]:
    """Stop words that are no identity terms."""
    keep = {t.lower() for t in terms}
    return [w for w in stop_words if w.lower() not in keep]


def negation_tokens() -> list[str]:
    """All tokens that open a negation scope."""
    bare = [w.replace("'", "") for w in lx.NEGATION_CONTRACTIONS]
    return lx.NEGATION_WORDS + lx.NEGATION_CONTRACTIONS + bare


def negation_pattern() -> str:
    """Whole-word pattern of the negation triggers, for lower-cased text."""
    return tx.whole_word(negation_tokens())


def mark_negation(
    text: Column,
    terms: Sequence[str],
    stop_words: Sequence[str] | None = None,
    preserve_case: bool = True,
) -> Column:
    """Tokens joined by blanks, with ``NOT_`` before the negated ones; ``""`` for NULL.

    A negation opens a scope that the next terminator or negation closes. Identity terms in
    the scope stay as they are and do not count. Of the other tokens, the first and the second
    are marked if they may be, and the third if it may be and neither of the two before was.
    Each of the three cases is one replacement over the joined tokens, so nothing is exploded
    or shuffled.
    """
    term_set = {t.lower() for t in terms}
    stops = default_stop_words() if stop_words is None else list(stop_words)
    closing = {t.lower() for t in lx.SCOPE_TERMINATORS}
    opening = {t.lower() for t in negation_tokens()} - closing
    identity = {t for t in term_set if " " not in t} - closing - opening
    special = closing | opening | identity
    unmarked = {w.lower() for w in (*lx.NON_NEGATABLE, *content_stop_words(stops, terms))} - special

    end = "(?![^ ])"

    def token_in(values: set[str]) -> str:
        return f"(?:{tx.any_of(list(values))}){end}" if values else "(?!)"

    firsts = "".join(sorted({w[0] for w in opening}))
    opener = f"(?=[{firsts}])(?<![^ ]){token_in(opening)}"
    skipped = f"(?: {token_in(identity)})*+"
    ordinary = f" (?!{token_in(special)})[^ ]++"
    plain = f" {token_in(unmarked)}"
    may_mark = f"(?!{token_in(special | unmarked)})(?=[^ ])"

    toks = tx.tokens(text)
    if not preserve_case:
        keep = sorted(special)
        toks = F.transform(toks, lambda t: F.when(F.lower(t).isin(keep), t).otherwise(F.lower(t)))
    flags = "(?i)" if all(w.isascii() for w in special | unmarked) else "(?iu)"

    def marked(joined: Column) -> Column:
        out = joined
        for before in (
            skipped,
            skipped + ordinary + skipped,
            skipped + plain + skipped + plain + skipped,
        ):
            pattern = f"{flags}({opener}{before} ){may_mark}"
            out = F.regexp_replace(out, pattern, f"$1{lx.NEGATION_PREFIX}")
        return F.when(joined.rlike(flags + opener), out).otherwise(joined)

    return F.coalesce(let(tx.joined(toks), marked), F.lit(""))


def polarity(
    text: Column,
    terms: Sequence[str],
    negative: Sequence[str] = lx.NEGATIVE_WORDS,
    positive: Sequence[str] = lx.POSITIVE_WORDS,
    window: int = 5,
) -> Column:
    """Struct of the four polarity counts; zeros for NULL.

    Per phrase: one negation at most; per identity term found as a substring, the words around
    the first token holding it are looked up in the two word lists. A term of several words
    that no single token holds takes the whole phrase as its context.
    """
    wanted = string_array(sorted({t.lower() for t in terms}))
    pattern = negation_pattern()
    hit_type = "array<struct<n:int,pos:int,neg:int>>"

    def term_hit(toks: Column, term: Column) -> Column:
        def with_context(first: Column) -> Column:
            start = F.greatest(first - window, F.lit(0))
            context = F.when(
                first >= 0, F.slice(toks, start + 1, first + window + 1 - start)
            ).otherwise(toks)
            counted = (first >= 0) | F.contains(term, F.lit(" "))
            return let(
                context,
                lambda ctx: F.struct(
                    counted.cast("int").alias("n"),
                    (counted & tx.has_any(ctx, positive)).cast("int").alias("pos"),
                    (counted & tx.has_any(ctx, negative)).cast("int").alias("neg"),
                ),
            )

        holds = F.transform(toks, lambda w: F.contains(w, term))
        return let(F.array_position(holds, F.lit(True)).cast("int") - 1, with_context)

    def per_phrase(low: Column, present: Column) -> Column:
        def with_terms(found: Column) -> Column:
            hits = let(tx.tokens(low), lambda toks: F.transform(found, lambda t: term_hit(toks, t)))
            return let(
                F.struct(low.rlike(pattern).cast("int").alias("negated"), hits.alias("hits")),
                lambda s: F.struct(
                    (s["negated"] * array_total(s["hits"]["n"], "int")).alias("n"),
                    array_total(s["hits"]["pos"], "int").alias("pos"),
                    array_total(s["hits"]["neg"], "int").alias("neg"),
                ),
            )

        none = F.lit(None).cast("struct<n:int,pos:int,neg:int>")
        return let(
            F.filter(present, lambda t: F.contains(low, t)),
            lambda found: F.when(F.size(found) > 0, with_terms(found)).otherwise(none),
        )

    def all_counts(low: Column) -> Column:
        # A match takes the rest of its phrase with it, so a phrase counts once.
        negations = F.regexp_count(low, F.lit(f"{pattern}[^.!?]*+"))
        present = F.filter(wanted, lambda t: F.contains(low, t))

        def in_phrases(found: Column) -> Column:
            # Only terms the text holds are looked for in its phrases.
            per = F.transform(tx.phrases(low), lambda p: per_phrase(p, found))
            held = F.filter(per, lambda s: s.isNotNull())
            return F.when(F.size(found) > 0, held).otherwise(F.array().cast(hit_type))

        return let(
            let(present, in_phrases),
            lambda p: F.struct(
                negations.cast("int").alias(POLARITY_COLUMNS[0]),
                *[
                    array_total(p[field], "int").alias(name)
                    for field, name in zip(("n", "pos", "neg"), POLARITY_COLUMNS[1:])
                ],
            ),
        )

    return let(F.lower(F.coalesce(text, F.lit(""))), all_counts)
