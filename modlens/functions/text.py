"""Cleaning and tokenising of text columns.

All functions take and return columns and run inside the JVM, but for the shorthand of ASCII texts. NULL in gives NULL out, but
for the count functions used as features, which say so.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions.arrays import let, string_array, string_map

# Character classes, written out so that they do not depend on the Java version.
# \w comes first: it settles ASCII letters without a look at the Unicode category.
WORD_CHARS = r"\w\p{L}\p{M}\p{N}"
SPACE_CHARS = r"\t\n\x0b\f\r\x1c-\x1f \x85\p{Z}"
WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
SENTENCE_MARK = "\x01"
TITLES = "Mr|Mrs|Ms|Dr|St|Prof"


def quote(term: str) -> str:
    """A term as a literal inside a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII) if term.isascii() else f"\\Q{term}\\E"


def any_of(terms: Iterable[str]) -> str:
    """Alternation of literal terms, longer ones first.

    Common beginnings are written once, so a position that begins no term fails after one
    comparison per first letter and not after one per term.
    """
    by_first: dict[str, set[str]] = {}
    for term in set(terms):
        by_first.setdefault(term[:1], set()).add(term[1:])
    complete = "" in by_first
    by_first.pop("", None)
    parts = []
    for first in sorted(by_first):
        rest = by_first[first]
        tail = any_of(rest)
        grouped = f"(?:{tail})" if len(rest) > 1 and not tail.startswith("(?:") else tail
        parts.append(quote(first) + grouped)
    if complete:
        return f"(?:{'|'.join(parts)})?" if parts else ""
    return "|".join(parts)


def whole_word(terms: Iterable[str]) -> str:
    """Any of the terms with no word character on either side.

    The look at the first character comes first, as it is the cheapest test and fails at most
    places.
    """
    listed = sorted(set(terms))
    if not listed:
        return "(?!)"
    firsts = "".join(sorted({re.sub(r"(\W)", r"\\\1", t[0]) for t in listed}))
    return rf"(?=[{firsts}])(?<!\w)(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{any_of(listed)})(?!{WORD})"


# -- links, addresses, characters ------------------------------------------------------


def has_url(text: Column, marks: Sequence[str] = ("http",)) -> Column:
    """True where the text holds one of the marks (``http`` by default)."""
    cond = F.lit(False)
    for mark in marks:
        cond = cond | F.contains(text, F.lit(mark))
    return cond


def remove_urls(text: Column) -> Column:
    """Delete ``http(s)://…`` and ``www.…`` up to the next blank."""
    pattern = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"

    def cut(t: Column) -> Column:
        marked = F.contains(t, F.lit("http")) | F.contains(t, F.lit("www."))
        return F.when(marked, F.regexp_replace(t, pattern, "")).otherwise(t)

    return let(text, cut)


def _email_body() -> str:
    c = lx.EMAIL_CHARS
    return rf"[{c}]++@[{c}]+\.[a-z]+"


def starts_with_email(text: Column) -> Column:
    """True where the text begins with a lower-case e-mail address."""
    return text.rlike(rf"\A{_email_body()}")


def remove_emails(text: Column) -> Column:
    """Delete lower-case e-mail addresses.

    A match may only begin where a run of address characters begins, or where the match
    before ended; a long run without ``@`` is thus read once and not once per character.
    """
    pattern = rf"(?:\G|(?<![{lx.EMAIL_CHARS}])){_email_body()}"

    def cut(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, pattern, "")).otherwise(t)

    return let(text, cut)


def keep_printable(text: Column) -> Column:
    """Drop every character outside printable ASCII (tab and line breaks are kept)."""
    return F.regexp_replace(text, r"[^\x20-\x7e\t\n\r\x0b\x0c]+", "")


# -- shorthand expansion -----------------------------------------------------------------


def _is_word(key: str) -> bool:
    return re.fullmatch(r"\w+", key) is not None


def _leading_word(key: str) -> str:
    return re.match(r"\w*", key).group()


def expand_shorthand(text: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """Replace whole keys of a dictionary by their expansion; case matters.

    A key matches where no word character touches it on either side; where several keys match
    at one place, the earlier entry wins. The text is cut into pieces once: keys holding a
    symbol are found by a short alternation, keys that are plain words are found by one hash
    lookup per word, so the cost does not grow with the dictionary.
    """
    table = dict(entries)
    order = {key: i for i, key in enumerate(table)}
    plain = {k: v for k, v in table.items() if _is_word(k)}

    def shadowed(key: str) -> bool:
        # The plain word the key begins with matches wherever the key does.
        head = _leading_word(key)
        return head in plain and order[head] < order[key]

    symbols = {k: v for k, v in table.items() if k not in plain and not shadowed(k)}
    starts = "".join(sorted({re.sub(r"(\W)", r"\\\1", k[0]) for k in symbols if not _is_word(k[0])}))
    parts = []
    if symbols:
        parts.append(f"(?<!{WORD})({'|'.join(quote(k) for k in symbols)})(?!{WORD})")
    parts.append(f"{WORD}+")
    if starts:
        parts.append(f"[^{WORD_CHARS}{starts}]+")
    parts.append(f"[^{WORD_CHARS}]" if starts else f"[^{WORD_CHARS}]+")
    pattern = F.lit("|".join(parts))
    single = [k for k in symbols if len(k) == 1]

    def swap(piece: Column, values: dict[str, str]) -> Column:
        # The hash test comes first; only a key is looked up in the map.
        known = piece.isin(list(values))
        return F.when(known, F.element_at(string_map(values), piece)).otherwise(piece)

    def rewritten(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, pattern, F.lit(0))
        out = F.array_join(F.transform(pieces, lambda p: swap(p, plain | symbols)), "")
        if not single:
            return out
        # A one-character key that touches a word is left over as a piece of its own and must
        # stay. Texts holding such a character are cut by key (group 1) as well as by piece.
        keyed = F.regexp_extract_all(t, pattern, F.lit(1))
        exact = F.zip_with(
            pieces, keyed, lambda p, k: F.when(k != "", swap(k, symbols)).otherwise(swap(p, plain))
        )
        return F.when(t.rlike(any_of(single)), F.array_join(exact, "")).otherwise(out)

    return let(text, lambda t: F.when(t.rlike(whole_word(table)), rewritten(t)).otherwise(t))


def expand_all(
    text: Column, passes: Sequence[Sequence[tuple[str, str]]] = lx.SUBSTITUTION_PASSES
) -> Column:
    """Run the dictionary passes in order, each on the output of the one before.

    A text that holds no key of any pass is left as it is after one look.
    """
    keys = [key for entries in passes for key, _ in entries]
    if not keys:
        return text

    def all_passes(t: Column) -> Column:
        for entries in passes:
            if entries:
                t = expand_shorthand(t, entries)
        return t

    return let(
        text, lambda t: F.when(t.rlike(whole_word(keys)), all_passes(t)).otherwise(t)
    )


def _between_edges(key: str) -> str:
    # A word's edge before or behind a word character, none before or behind another character.
    first, last = (r"\b" if re.match(r"\w", c, re.ASCII) else r"\B" for c in (key[0], key[-1]))
    return first + re.sub(r"([^A-Za-z0-9_])", r"\\\1", key) + last


def expand_ascii(
    text: Column, passes: Sequence[Sequence[tuple[str, str]]] = lx.SUBSTITUTION_PASSES, drop: bool = False
) -> Column:
    """``expand_all`` of texts that hold printable ASCII and blanks only, in Arrow batches.

    With ``drop``, ``keep_printable`` of any texts is taken in the same batches first. Arrow's automata read a text once, however many keys there are, and set marks around the keys found.
    Keys with other characters cannot be in such a text; values with others go the way of ``expand_all``.
    """
    plain = re.compile(r"[\t-\r -~]+")
    tables = [{k: v for k, v in dict(entries).items() if plain.fullmatch(k)} for entries in passes]
    tables = [t for t in tables if t]
    if not tables:
        return keep_printable(text) if drop else text
    if not all(plain.fullmatch(v) or not v for t in tables for v in t.values()):
        return expand_all(keep_printable(text) if drop else text, passes)
    # Alternatives stand in the order of the entries, so that the earlier one wins.
    steps = [("|".join(map(_between_edges, t)), t) for t in tables]

    def printable(batch: pa.Array) -> pa.Array:
        whole = pa.concat_arrays([batch.cast(pa.large_string())])
        at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        # All bytes of other characters lie beyond ASCII.
        kept = (raw >= 0x20) & (raw <= 0x7E) | (raw >= 0x09) & (raw <= 0x0D)
        dropped = np.flatnonzero(~kept)
        if not len(dropped):
            return batch
        at = at - at[0]
        at, mask = at - np.searchsorted(dropped, at), None
        if batch.null_count:
            mask = pa.py_buffer(np.packbits(whole.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw[kept]), mask).cast(batch.type)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if drop and len(batch):
                batch = printable(batch)
            for keys, table in steps:
                found = pc.fill_null(pc.match_substring_regex(batch, keys), False)
                if not pc.any(found).as_py():
                    continue
                marked = pc.replace_substring_regex(batch.filter(found), keys, "\x01\\0\x01").to_pylist()
                for n, t in enumerate(marked):
                    parts = t.split("\x01")
                    parts[1::2] = [table[k] for k in parts[1::2]]
                    marked[n] = "".join(parts)
                batch = pc.replace_with_mask(batch, found, pa.array(marked, batch.type))
            yield batch

    return run(text)


def clean(
    text: Column, passes: Sequence[Sequence[tuple[str, str]]] = lx.SUBSTITUTION_PASSES
) -> Column:
    """The cleaning chain: links, addresses, non-ASCII characters, shorthand."""
    return expand_ascii(remove_emails(remove_urls(text)), passes, drop=True)


# -- splitting ----------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def word_total(text: Column) -> Column:
    """Number of words between blanks, without building them."""
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def phrases(text: Column) -> Column:
    """Stretches between ``.``, ``!`` and ``?``; blank ones are left out."""
    return F.filter(
        F.regexp_extract_all(text, F.lit("[^.!?]+"), F.lit(0)), lambda p: p.rlike(NOT_SPACE)
    )


_TOKEN = (
    rf"[nN]'[tT](?!{WORD})|{WORD}+(?:\.(?<=(?<!{WORD})(?:{TITLES})\.))?"
    rf"|'(?i:s|re|ve|ll|d|m)(?!{WORD})|[^{WORD_CHARS}{SPACE_CHARS}]"
)


def tokens(text: Column) -> Column:
    """Words and punctuation marks; ``don't`` gives ``do``, ``n't`` and ``cannot`` ``can``, ``not``."""

    def apart(t: Column) -> Column:
        cut = F.regexp_replace(
            t, rf"(?<!{WORD})([cC][aA][nN])([nN][oO][tT])(?!{WORD})", "$1 $2"
        )
        cut = F.regexp_replace(cut, rf"({WORD})([nN]'[tT])(?!{WORD})", "$1 $2")
        return F.when(t.rlike("[nN](?:'[tT]|[nN][oO][tT])"), cut).otherwise(t)

    return F.regexp_extract_all(let(text, apart), F.lit(_TOKEN), F.lit(0))


def tokens_ascii(text: Column) -> Column:
    """``tokens`` of texts that hold printable ASCII and blanks only, in Arrow batches."""
    apart = [r"\b([cC][aA][nN])([nN][oO][tT])\b", r"(\w)([nN]'[tT])\b"]
    sign = rf"\b[nN]'[tT]\b|\b(?:{TITLES})\.|'(?i:s|re|ve|ll|d|m)\b|[^\w\t-\r ]"

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for pattern in apart:
                batch = pc.replace_substring_regex(batch, pattern, r"\1 \2")
            # Only what is no plain word is set apart; blanks part the rest.
            yield pc.ascii_split_whitespace(pc.replace_substring_regex(batch, sign, r" \0 "))

    return F.array_remove(run(text), "")


def _sentence_marked(text: Column) -> Column:
    # The full stop of a title does not end a sentence.
    guarded = F.regexp_replace(text, rf"(?<!{WORD})({TITLES})\.", "$1\x02")
    return F.regexp_replace(guarded, rf"([.!?]+[\"')\]]*){SPACE}+", f"$1{SENTENCE_MARK}")


def sentences(text: Column) -> Column:
    """Sentences: they end at ``.``, ``!`` or ``?`` (and closing quotes) before a blank."""
    parts = F.split(_sentence_marked(text), SENTENCE_MARK)
    tidy = F.transform(
        parts,
        lambda s: F.regexp_replace(F.translate(s, "\x02", "."), f"^{SPACE}+|{SPACE}+$", ""),
    )
    return F.filter(tidy, lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """Number of sentences, without building them."""
    end = rf"[.!?](?<!(?<!{WORD})(?:{TITLES})\.)[.!?]*[\"')\]]*{SPACE}+(?={NOT_SPACE})"
    inner = F.regexp_count(text, F.lit(end))
    return F.when(text.rlike(NOT_SPACE), inner + 1).otherwise(F.when(text.isNotNull(), F.lit(0)))


def corpus_words(text: Column) -> Column:
    """Lower-cased words for vocabulary work: ASCII punctuation but ``'`` separates, as do blanks."""
    spaced = F.regexp_replace(F.lower(text), r"[!-&(-/:-@\[-`{-~\t\n]+", " ")
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


def joined(tokens_col: Column) -> Column:
    """Tokens joined by one blank."""
    return F.array_join(tokens_col, " ")


def ngrams(tokens_col: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of the given sizes, joined by a blank."""

    def of_size(toks: Column, n: int) -> Column:
        if n == 1:
            return toks
        starts = F.sequence(F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))
        return F.when(F.size(toks) >= n, grams).otherwise(string_array([]))

    return let(tokens_col, lambda toks: F.concat(*[of_size(toks, n) for n in range(low, high + 1)]))


# -- counting --------------------------------------------------------------------------------


def count_matches(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches of a pattern."""
    return F.regexp_count(text, F.lit(pattern))


def count_literal(text: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a literal, case kept."""
    return F.when(
        F.contains(text, term),
        F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)),
    ).otherwise(F.lit(0)).cast("bigint")


def char_ratio(text: Column, char_class: str) -> Column:
    """Share of the characters in a class; 0 for an empty text."""
    kept = F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))
    return F.coalesce(F.try_divide(kept, F.length(text)), F.lit(0.0))


def char_set_ratio(text: Column, chars: str) -> Column:
    """Share of the characters that are one of ``chars``; 0 for an empty text."""
    other = F.length(F.translate(text, chars, ""))
    return F.coalesce(F.try_divide(F.length(text) - other, F.length(text)), F.lit(0.0))


def is_blank(text: Column) -> Column:
    """NULL, empty, or blanks only."""
    return text.isNull() | ~text.rlike(NOT_SPACE)


def count_in(tokens_col: Column, wanted: Sequence[str]) -> Column:
    """Number of tokens in a word list."""
    return F.size(F.filter(tokens_col, lambda t: t.isin(list(wanted))))


def has_any(tokens_col: Column, wanted: Sequence[str]) -> Column:
    """True where one of the tokens is in a word list."""
    return F.arrays_overlap(tokens_col, string_array(wanted))
