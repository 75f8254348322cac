"""Identity-term mentions inside one text, without exploding it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import text as tx
from modlens.functions.arrays import let, literal, running_totals

Lexicon = dict[str, list[str]]
Sentiment = Callable[[Column], Column]

MARK, OTHER = "\x01", "\x02"
FOUND_TYPE = "array<struct<term:string,position:int,context:string,context_sentiment:double>>"


def category_pattern(terms: Iterable[str]) -> str:
    """Whole-word pattern for terms, for lower-cased text."""
    return tx.whole_word(t.lower() for t in terms)


def _parts(term: str) -> list[str]:
    return re.findall(r"\w+", term)


def separable(terms: Iterable[str]) -> bool:
    """True where no two terms can overlap in a text.

    Then each term can be counted by itself, and terms of all categories can be searched
    together. A term that is one word can only overlap a longer term that holds it.
    """
    seen: set[str] = set()
    longer: set[str] = set()
    for term in {t.lower() for t in terms}:
        parts = _parts(term)
        if len(parts) == 1 and parts[0] == term:
            seen.add(term)
        elif len(set(parts)) != len(parts) or longer & set(parts) or not parts:
            return False
        else:
            longer |= set(parts)
    return not seen & longer


def listed_words(text: Column, terms: Iterable[str]) -> Column:
    """The words of a text that are terms, in order, lower-cased."""
    single = sorted({t.lower() for t in terms if _parts(t) == [t]})
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{tx.WORD}+"), F.lit(0))
    return F.filter(found, lambda w: w.isin(single))


def mention_counts(text: Column, words: Column, lexicon: Lexicon) -> dict[str, Column]:
    """Per category the number of whole-word mentions, any case; 0 for NULL.

    ``words`` are the ``listed_words`` of all terms: the text is cut into words once, however
    many categories there are. Terms of several words are searched where the text holds them.
    """
    low = F.lower(text)
    out = {}
    for category, terms in lexicon.items():
        lowered = [t.lower() for t in terms]
        if separable(lowered):
            n = tx.count_in(words, [t for t in lowered if _parts(t) == [t]])
            for t in lowered:
                if _parts(t) != [t]:
                    n = n + F.when(
                        F.contains(low, F.lit(t)), tx.count_matches(low, category_pattern([t]))
                    ).otherwise(F.lit(0))
        else:
            n = tx.count_matches(low, category_pattern(lowered))
        out[category] = F.coalesce(n, F.lit(0)).cast("int")
    return out


def no_sentiment(context: Column) -> Column:
    """The default context sentiment: 0 for every context."""
    return F.lit(0.0)


def lexicon_sentiment(
    positive: Sequence[str] = lx.POSITIVE_WORDS, negative: Sequence[str] = lx.NEGATIVE_WORDS
) -> Sentiment:
    """(positive - negative) / words, over the lower-cased words of a context."""

    def score(context: Column) -> Column:
        return let(
            tx.words(F.lower(context)),
            lambda ws: F.coalesce(
                F.try_divide(tx.count_in(ws, positive) - tx.count_in(ws, negative), F.size(ws)),
                F.lit(0.0),
            ),
        )

    return score


def found_terms(
    text: Column, terms: Iterable[str], window: int = 5, sentiment: Sentiment = no_sentiment
) -> Column:
    """Mentions of terms as structs (term, position, context, context_sentiment), in text order.

    The text is cut at the matches. Character positions and word positions are running sums
    over the pieces, so the work is linear in the text.
    """
    pattern = category_pattern(terms)
    word_start = rf"{tx.SPACE}(?={tx.NOT_SPACE})"

    def assemble(found: Column, gaps: Column, all_words: Column) -> Column:
        # gaps[k] is the text between match k-1 and match k. Words that begin inside a gap are
        # counted once; the first gap is led by a blank so that the very first word counts.
        inner = F.transform(
            gaps,
            lambda g, k: F.regexp_count(
                F.when(k == 0, F.concat(F.lit(" "), g)).otherwise(g), F.lit(word_start)
            ),
        )
        # Words that begin inside or at a match: its own first word if the gap ends in a blank
        # or there is no text before it, and the words after its first blank.
        own = F.zip_with(
            gaps, found, lambda g, m: F.regexp_count(F.concat(F.right(g, F.lit(1)), m), F.lit(word_start))
        )
        own = F.transform(
            own, lambda n, k: n + F.when((k == 0) & (gaps[0] == ""), F.lit(1)).otherwise(F.lit(0))
        )
        lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))

        def record(s: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                at = (s["ends"][k] - F.length(m)).cast("int")
                ix = s["word_ends"][k] - s["own"][k]
                first = F.greatest(ix - window, F.lit(0)).cast("int")
                width = (ix + window + 1 - first).cast("int")
                context = F.array_join(F.slice(all_words, first + 1, width), " ")
                return F.struct(
                    m.alias("term"),
                    at.alias("position"),
                    context.alias("context"),
                    sentiment(context).cast("double").alias("context_sentiment"),
                )

            return F.transform(found, one)

        return let(
            F.struct(inner.alias("inner"), own.alias("own"), lengths.alias("lengths")),
            lambda p: let(
                F.struct(
                    p["own"].alias("own"),
                    running_totals(p["lengths"]).alias("ends"),
                    running_totals(F.zip_with(p["inner"], p["own"], lambda a, b: a + b)).alias(
                        "word_ends"
                    ),
                ),
                record,
            ),
        )

    def found_in(low: Column) -> Column:
        return let(
            F.struct(
                F.regexp_extract_all(low, F.lit(pattern), F.lit(0)).alias("found"),
                # Cut at a mark in place of each match; a mark in the text itself is swapped
                # for another character first. The piece after the last match is not needed.
                F.split(
                    F.regexp_replace(F.translate(low, MARK, OTHER), pattern, MARK), MARK
                ).alias("pieces"),
                tx.words(text).alias("words"),
            ),
            lambda s: assemble(
                s["found"], F.slice(s["pieces"], F.lit(1), F.size(s["found"])), s["words"]
            ),
        )

    return F.when(F.lower(text).rlike(pattern), let(F.lower(text), found_in)).otherwise(
        F.array().cast(FOUND_TYPE)
    )


def _in_category(found: Column, category: str) -> Column:
    fields = ("term", "position", "context", "context_sentiment")
    return F.transform(
        found,
        lambda m: F.struct(F.lit(category).alias("category"), *[m[f].alias(f) for f in fields]),
    )


def mentions(
    text: Column,
    lexicon: Lexicon = lx.IDENTITY_TERMS,
    window: int = 5,
    sentiment: Sentiment = no_sentiment,
) -> Column:
    """Mentions of all categories, category after category, each in text order.

    Where terms cannot overlap, the text is searched once for all of them.
    """
    if not separable(t for terms in lexicon.values() for t in terms):
        per = [_in_category(found_terms(text, t, window, sentiment), c) for c, t in lexicon.items()]
        return F.concat(*per)

    def of(found: Column, category: str, terms: Sequence[str]) -> Column:
        listed = [t.lower() for t in terms]
        return _in_category(F.filter(found, lambda m: m["term"].isin(listed)), category)

    def spread(found: Column) -> Column:
        return F.concat(*[of(found, c, terms) for c, terms in lexicon.items()])

    return let(found_terms(text, lx.distinct_terms(lexicon), window, sentiment), spread)


def term_counts(text: Column, lexicon: Lexicon = lx.IDENTITY_TERMS) -> Column:
    """Per (category, term) the case-sensitive substring count; terms that occur only."""
    listed = [{"category": c, "term": t} for c, terms in lexicon.items() for t in terms]
    pairs = literal(listed, "array<struct<category:string,term:string>>")
    present = F.filter(pairs, lambda p: F.contains(text, p["term"]))
    return F.transform(
        present,
        lambda p: F.struct(
            p["category"].alias("category"),
            p["term"].alias("term"),
            tx.count_literal(text, p["term"]).alias("n"),
        ),
    )
