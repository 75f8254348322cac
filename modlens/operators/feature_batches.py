"""The text features of cleaned comments in Arrow batches: tokens as places in the bytes, words as numbers.

Texts hold printable ASCII and blanks only, as cleaning leaves them. The rows are those of
``identity_columns``, ``normalise`` and ``native_features`` one after another, which stay for other texts.
A text is cut into tokens once, by numpy over its bytes; the tokens of the normalised text follow
from them. Arrow's automata find what is no token; places that hold a term are few and looked at one by one.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import negation as ng
from modlens.functions import text as tx
from modlens.functions.arrays import with_fields
from modlens.functions.features import NATIVE_FEATURES, hate_pattern
from modlens.functions.identity import Lexicon, separable

# Bytes of text that are looked at a time.
STEP = 512 << 10
SPACE, WORD, OTHER = range(3)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[*b"\t\n\x0b\x0c\r "]] = SPACE
_KIND[[*b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*string.punctuation.encode()]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?"]] = True
_PREFIX = np.frombuffer(lx.NEGATION_PREFIX.encode(), np.uint8)
_TITLES = [t.encode() for t in tx.TITLES.split("|")]
_TAILS = [b"s", b"re", b"ve", b"ll", b"d", b"m"]
# Runs of word characters that the tokens cut or join to a sign.
_CUT = {"can", "not", "cannot", "t", *(t.decode() for t in _TAILS), *(t.decode().lower() for t in _TITLES)}
_LISTED = {
    "aggressive_word_ratio": lx.AGGRESSIVE_WORDS, "generalization_ratio": lx.GENERALIZING_WORDS,
    **{f"{name}_ratio": ws for name, ws in lx.EMOTION_WORDS.items()},
}
_INTS = {"word_count", "sentence_count", "hate_pattern_count", "stereotype_pattern_count"}


def fits(lexicon: Lexicon) -> bool:
    """True where the terms of a lexicon can be counted by tokens: words that the tokens keep whole, or several words."""
    terms = {t.lower() for t in lx.distinct_terms(lexicon)}
    return all(map(separable, lexicon.values())) and all(
        re.fullmatch(r"\w+( \w+)*", t, re.ASCII) and not set(t.split()) & _CUT for t in terms
    )


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of some bytes each, one text at least; NULL as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // STEP
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if len(texts) else []
    for a, b in zip(cuts, cuts[1:]):
        yield pa.concat_arrays([texts.slice(a, b - a)])


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of an array begins and ends in its bytes, and the bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return at - at[0], raw


def _strings(at: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))


class Tokens:
    """The tokens of some texts, as ``functions.text.tokens`` cuts them.

    ``starts`` are places in the bytes, ``bounds`` the tokens at which the texts begin and end; ``chars`` are
    the bytes without blanks, and ``offsets`` say where in them the tokens begin and end.
    """

    def __init__(self, at: np.ndarray, raw: np.ndarray):
        self.at, self.raw, self.low = at, raw, _LOWER[raw]
        kind = _KIND[raw]
        # One byte more, so that a place behind the last text can be looked at.
        self.word = word = np.append(kind == WORD, False)
        start = kind != SPACE
        start[1:] &= ~(word[:-2] & word[1:-1]) if len(raw) else True
        begins = at[:-1][at[:-1] < at[1:]]
        start[begins] = kind[begins] != SPACE
        runs = start & word[:-1]
        titled, nots = self._signs(start, runs)
        self.starts = np.flatnonzero(start)
        self.bounds = np.searchsorted(self.starts, at)
        kept = kind != SPACE
        self.chars = raw[kept]
        cum = np.cumsum(kept, dtype=np.int32)
        self.offsets = np.append(cum[self.starts] - 1, len(self.chars))
        self.lengths = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.bounds))
        self.first = raw[self.starts]
        self.last = self.chars[self.offsets[1:] - 1]
        self.title = np.zeros(len(self.starts), bool)
        self.title[np.searchsorted(self.starts, titled, "right") - 1] = True
        self.nots = nots
        # A token "n't", and the one before it where both were one run of word characters.
        self.cut = np.zeros(len(self.starts), bool)
        self.cut[np.searchsorted(self.starts, nots)] = True
        split = nots[~runs[nots]]
        before = np.searchsorted(self.starts, split) - 1
        self.parted = np.zeros(len(self.starts), bool)
        self.parted[before] = True
        # The runs of word characters that end in the n of "n't".
        self.run_docs = self.doc[before] if len(split) else np.zeros(0, int)
        self.run_words = [
            re.search(rb"\w*$", self.low[a : p + 1].tobytes()).group().decode()
            for a, p in zip(self.starts[before].tolist(), split.tolist())
        ]

    def _signs(self, start: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut and join what is no plain run or sign; the places of joined full stops, and of "n't"."""
        raw, low, word, at = self.raw, self.low, self.word, self.at

        def ends(p: np.ndarray) -> np.ndarray:
            return at[np.searchsorted(at, p, "right")]

        def spells(p: np.ndarray, letters: bytes, chars: np.ndarray = low) -> np.ndarray:
            """Of places inside texts, those from which these letters follow in the same text."""
            p = p[p + len(letters) <= ends(p)]
            for k, c in enumerate(letters):
                p = p[chars[p + k] == c]
            return p

        def closed(p: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
            """Of places, those behind whose ``n`` characters ``of`` does not go on in the same text."""
            behind = p + n
            return p[(behind >= ends(p)) | ~of[behind]]

        whole = spells(np.flatnonzero(runs & (low == ord("c"))), b"cannot")
        start[closed(whole, 6, word) + 3] = True
        signs = np.flatnonzero(raw == ord("'"))
        begun = np.zeros(len(raw) + 1, bool)
        begun[at] = True
        nots = signs[(signs > 0) & ~begun[signs]] - 1
        nots = spells(nots, b"n't")
        last = closed(nots, 3, word)
        # Where one behind it is cut off, a run's first "n't" ends before it.
        nots = np.union1d(last, nots[runs[nots] & np.isin(nots + 3, last)])
        start[nots] = True
        start[nots + 1] = start[nots + 2] = False
        # A tail ends where its run does, or where "n't" begins.
        goes_on = np.append(word[:-1] & ~start, False)
        for tail in _TAILS:
            at_sign = closed(spells(signs, b"'" + tail), 1 + len(tail), goes_on)
            at_sign = at_sign[start[at_sign]]
            start[at_sign + 1] = False
        stops = np.flatnonzero((raw == ord(".")) & ~begun[:-1])
        stops = stops[word[stops - 1]]
        titled = []
        for title in _TITLES:
            p = stops[stops >= len(title)] - len(title)
            p = spells(p, title + b".", raw)
            titled.append(p[runs[p]] + len(title))
        titled = np.concatenate(titled)
        start[titled] = False
        return titled, nots


class Features:
    """The model inputs of texts for one lexicon."""

    def __init__(self, lexicon: Lexicon, stop_words: Sequence[str] | None = None):
        self.lexicon = {c: [t.lower() for t in ts] for c, ts in lexicon.items()}
        every = lx.distinct_terms(lexicon)
        terms = sorted({t.lower() for t in every})
        self.single = [t for t in terms if " " not in t]
        self.several = [t for t in terms if " " in t]
        stops = ng.default_stop_words() if stop_words is None else list(stop_words)
        closing = {t.lower() for t in lx.SCOPE_TERMINATORS}
        opening = {t.lower() for t in ng.negation_tokens()} - closing
        identity = set(self.single) - closing - opening
        special = closing | opening | identity
        unmarked = {w.lower() for w in (*lx.NON_NEGATABLE, *ng.content_stop_words(stops, every))} - special
        sets = [closing | opening, opening, identity, unmarked, {"cannot"}, lx.POSITIVE_WORDS, lx.NEGATIVE_WORDS,
                *_LISTED.values(), *self.lexicon.values()]
        words = sorted({w for s in sets for w in s})
        self.words = pa.array(words, pa.large_string())
        # A row per set; the last column is for tokens in none.
        self.member = np.array([[w in s for w in words] + [False] for s in map(set, sets)])
        bare = "|".join(re.escape(w) for w in sorted(ng.negation_tokens(), key=len, reverse=True))
        self.negation = rf"\b(?:{bare})\b"
        self.hate = re.compile(hate_pattern(), re.ASCII)
        self.held: dict[str, list[int]] = {}

    def of(self, texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """All columns of one slice of texts."""
        at, raw = _parts(texts)
        t, n = Tokens(at, raw), len(texts)
        low = _strings(at, t.low)
        codes = pc.index_in(_strings(t.offsets, _LOWER[t.chars]), self.words)
        codes = pc.fill_null(codes, len(self.words)).to_numpy(zero_copy_only=False)
        shut, opener, identity, unmarked, cannot, positive, negative, *rest = self.member
        listed, categories = rest[: len(_LISTED)], rest[len(_LISTED) :]
        known = np.flatnonzero(codes < len(self.words))
        out: dict[str, np.ndarray | pa.Array] = {}

        # Mentions are runs of word characters; in "woman't" the run is "woman".
        whole = known[~t.parted[known]]
        total = np.zeros(n, np.int64)
        for (category, terms), member in zip(self.lexicon.items(), categories):
            found = np.bincount(t.doc[whole[member[codes[whole]]]], minlength=n)
            for doc, word in zip(t.run_docs.tolist(), t.run_words):
                found[doc] += word in terms
            for term in {x for x in terms if " " in x}:
                found = found + _counted(low, [term], _patterns([rf"\b{re.escape(term)}\b"]))
            out[f"{category}_mentions"] = found
            total = total + found
        out["identity_term_count"] = total
        marks = self._marks(t, codes, known, opener, identity, unmarked, shut)
        normal_at, normal = _joined(t, marks)
        normalised = _strings(normal_at, normal)
        out["normalized_text"] = normalised
        out |= self._polarity(t, low, codes, positive, negative)
        out |= self._native(t, normalised, _strings(normal_at, _LOWER[normal]), codes, known, marks, cannot, listed)
        return out

    def _marks(self, t: Tokens, codes, known, opener, identity, unmarked, shut) -> np.ndarray:
        """Which tokens are negated: behind an opener the first two, and the third where neither of them may be."""
        kind = np.zeros(len(codes) + 1, np.int8)
        kind[known] = unmarked[codes[known]] + 2 * identity[codes[known]] + 3 * shut[codes[known]]
        begin = known[opener[codes[known]]]
        end = t.bounds[1:][t.doc[begin]]

        def following(p: np.ndarray) -> np.ndarray:
            p = p + 1
            while (skip := (p < end) & (kind[np.minimum(p, len(codes))] == 2)).any():
                p = p + skip
            return p

        def kind_at(p: np.ndarray) -> np.ndarray:
            return np.where(p < end, kind[np.minimum(p, len(codes))], 3)

        marked = np.zeros(len(codes), bool)
        one = following(begin)
        kind_one = kind_at(one)
        two = following(one)
        kind_two = np.where(kind_one == 3, 3, kind_at(two))
        three = following(two)
        kind_three = np.where((kind_one == 1) & (kind_two == 1), kind_at(three), 3)
        for place, k in ((one, kind_one), (two, kind_two), (three, kind_three)):
            marked[place[k == 0]] = True
        return marked

    def _polarity(self, t: Tokens, low: pa.Array, codes, positive, negative) -> dict[str, np.ndarray]:
        n = len(low)
        negations = pc.count_substring_regex(low, self.negation + "[^.!?]*").to_numpy(zero_copy_only=False)
        out = {"negation_count": negations, **{c: np.zeros(n, np.int64) for c in ng.POLARITY_COLUMNS[1:]}}
        # Phrases are what stands between . ! and ?; a title's full stop belongs to its token.
        sign = (t.lengths == 1) & _ENDS[t.first]
        opens = np.zeros(len(codes) + 1, bool)
        opens[1:] = sign | t.title
        opens[t.bounds] = True
        edges = np.flatnonzero(opens)
        places, terms = self._held(t, low)
        several = self._several(t, low, edges)
        if not len(places) and not several:
            return out
        phrase = np.searchsorted(edges, places, "right") - 1
        # The first token of a phrase that holds a term, per phrase and term.
        _, first = np.unique(phrase * (len(self.single) + 1) + terms, return_index=True)
        phrase, places = phrase[first], places[first]
        begin, end = edges[phrase], edges[phrase + 1]
        # The sign that ends a phrase is no word of it, nor in a list.
        low_place, high_place = np.maximum(places - 5, begin), np.minimum(places + 6, end)
        if several:
            # A term of several words has its whole phrase around it.
            more = np.array(several)
            phrase = np.append(phrase, more)
            low_place, high_place = np.append(low_place, edges[more]), np.append(high_place, edges[more + 1])
        doc = t.doc[edges[phrase]]
        for column, member in (("identity_positive_context", positive), ("identity_negative_context", negative)):
            sums = np.append(0, np.cumsum(member[codes]))
            out[column] = np.bincount(doc[sums[high_place] > sums[low_place]], minlength=n)
        negated = re.compile(self.negation.encode())
        text, starts = t.low.tobytes(), np.append(t.starts, len(t.low))
        distinct, which = np.unique(phrase, return_inverse=True)
        stop = np.minimum(starts[edges[distinct + 1]], t.at[1:][t.doc[edges[distinct]]])
        holds = [
            negated.search(text[a:b]) is not None
            for a, b in zip(starts[edges[distinct]].tolist(), stop.tolist())
        ]
        out["identity_in_negation"] = np.bincount(doc[np.array(holds)[which]], minlength=n)
        return out

    def _held(self, t: Tokens, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that hold a term of one word, and the term's number: in order of the tokens."""
        none = np.zeros(0, int), np.zeros(0, int)
        if not self.single:
            return none
        # Every match gets a sign before it, so that the k-th stands k bytes further back.
        _, signed = _parts(pc.replace_substring_regex(low, "|".join(map(re.escape, self.single)), "\x01\\0"))
        found = np.flatnonzero(signed == 1)
        found = np.unique(np.searchsorted(t.starts, found - np.arange(len(found)), "right") - 1)
        if not len(found):
            return none
        places, terms = [], []
        ends = t.offsets[found + 1].tolist()
        chars = _LOWER[t.chars].tobytes()
        for place, a, b in zip(found.tolist(), t.offsets[found].tolist(), ends):
            token = chars[a:b].decode()
            if token not in self.held:
                if len(self.held) > 1 << 17:
                    self.held.clear()
                self.held[token] = [k for k, term in enumerate(self.single) if term in token]
            for k in self.held[token]:
                places.append(place)
                terms.append(k)
        return np.array(places, int), np.array(terms, int)

    def _several(self, t: Tokens, low: pa.Array, edges: np.ndarray) -> list[int]:
        """A phrase's number for each term of several words that it holds."""
        out = []
        for term in self.several:
            holds = pc.match_substring(low, term).to_numpy(zero_copy_only=False)
            for doc in np.flatnonzero(holds).tolist():
                a, b = t.at[doc], t.at[doc + 1]
                found = [m.start() + a for m in re.finditer(re.escape(term).encode(), t.low[a:b].tobytes())]
                tokens = np.searchsorted(t.starts, found, "right") - 1
                out += np.unique(np.searchsorted(edges, tokens, "right") - 1).tolist()
        return out

    def _hates(self, low: pa.Array) -> np.ndarray:
        return np.array([sum(1 for _ in self.hate.finditer(x)) for x in low.to_pylist()])

    def _native(self, t: Tokens, normalised, low, codes, known, marks, cannot, listed) -> dict[str, np.ndarray]:
        n = len(normalised)
        size = np.diff(t.bounds)

        def within(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(np.flatnonzero(flags), edges))

        marked = within(marks, t.bounds)
        # A mark parts from a sign, and a marked title from its full stop; a whole "cannot" is cut at last.
        apart = marks & ((_KIND[t.first] == OTHER) | t.title | t.cut)
        whole = known[cannot[codes[known]]]
        words = size + within(apart, t.bounds) + np.bincount(t.doc[whole[~marks[whole]]], minlength=n)
        ends = _ENDS[t.last] & ~(t.title & ~marks)
        ends[t.bounds[1:][size > 0] - 1] = False
        chars = np.diff(t.offsets[t.bounds]) + len(lx.NEGATION_PREFIX) * marked
        length = chars + np.maximum(size - 1, 0)
        literal = [p for p in lx.STEREOTYPE_PATTERNS if "(" not in p]
        pattern = [p for p in lx.STEREOTYPE_PATTERNS if "(" in p]
        out = {
            "word_count": words, "avg_word_length": _share(chars, words),
            "sentence_count": within(ends, t.bounds) + (size > 0),
            "uppercase_ratio": _share(within(_UPPER[t.raw], t.at) + _UPPER[_PREFIX].sum() * marked, length),
            "punctuation_ratio": _share(within(_PUNCTUATION[t.raw], t.at) + _PUNCTUATION[_PREFIX].sum() * marked, length),
            "hate_pattern_count": _counted(low, lx.HATE_TRIGGERS, self._hates) + _counted(low, lx.HATE_PHRASES, _literals(lx.HATE_PHRASES)),
            "stereotype_pattern_count": _counted(low, literal, _literals(literal)) + _counted(low, pattern, _patterns(pattern), False),
        }
        plain = known[~marks[known]]
        for name, member in zip(_LISTED, listed):
            out[name] = _share(np.bincount(t.doc[plain[member[codes[plain]]]], minlength=n), words)
        return out


Count = Callable[[pa.Array], np.ndarray]


def _counted(low: pa.Array, held: Sequence[str], count: Count, literal: bool = True) -> np.ndarray:
    """What is counted in each text, looked for only where one of some strings or patterns is held."""
    out = np.zeros(len(low), np.int64)
    if held:
        wanted = "|".join(map(re.escape, held) if literal else held)
        at = np.flatnonzero(pc.match_substring_regex(low, wanted).to_numpy(zero_copy_only=False))
        if len(at):
            out[at] = count(low.take(pa.array(at)))
    return out


def _literals(phrases: Sequence[str]) -> Count:
    return lambda low: sum(pc.count_substring(low, p).to_numpy(zero_copy_only=False).astype(np.int64) for p in phrases)


def _patterns(patterns: Sequence[str]) -> Count:
    return lambda low: sum(pc.count_substring_regex(low, p).to_numpy(zero_copy_only=False).astype(np.int64) for p in patterns)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _joined(t: Tokens, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of tokens joined by one blank, ``NOT_`` before the marked ones."""
    ahead = np.ones(len(marks), np.int64)
    begins = t.bounds[:-1][np.diff(t.bounds) > 0]
    ahead[begins] = 0
    ahead += len(_PREFIX) * marks
    ends = np.cumsum(ahead + t.lengths)
    out = np.full(int(ends[-1]) if len(ends) else 0, ord(" "), np.uint8)
    shift = (ends - t.offsets[1:]).astype(np.int32)
    out[np.arange(len(t.chars), dtype=np.int32) + np.repeat(shift, t.lengths)] = t.chars
    place = (ends - t.lengths)[marks] - len(_PREFIX)
    for k, c in enumerate(_PREFIX):
        out[place + k] = c
    return np.append(0, ends)[t.bounds], out


def batch_features(
    df: DataFrame, text_col: str = "text", lexicon: Lexicon = lx.IDENTITY_TERMS, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """The frame, whose texts are clean, with identity columns, ``normalized_text``, polarity and text features.

    The columns and their order are those of ``identity_columns``, ``normalise`` and ``native_features``.
    """
    counts = [*[f"{c}_mentions" for c in lexicon], "identity_term_count"]
    ints = {*counts, *ng.POLARITY_COLUMNS, *_INTS}
    columns = [*counts, "normalized_text", *ng.POLARITY_COLUMNS, *NATIVE_FEATURES]
    arrow = {c: pa.string() if c == "normalized_text" else pa.int32() if c in ints else pa.float64() for c in columns}
    kinds = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double"}
    stops = None if stop_words is None else list(stop_words)
    stops = ng.default_stop_words() if stops is None else stops

    @F.arrow_udf("struct<" + ", ".join(f"`{c}`: {kinds[k]}" for c, k in arrow.items()) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Features(lexicon, stops)
        for batch in batches:
            parts = [made.of(x) for x in _slices(batch)]
            fields = [
                pa.concat_arrays([pa.array(p[c]).cast(k) for p in parts]) if parts else pa.array([], k)
                for c, k in arrow.items()
            ]
            yield pa.StructArray.from_arrays(fields, list(arrow))

    rest = [c for c in df.columns if c not in {*columns, "has_identity_terms", "identity_context_sentiment"}]
    out = with_fields(df.select(*rest), {"_made": run(F.col(text_col))})
    made = {c: F.col(f"_made.`{c}`").alias(c) for c in columns}
    return out.select(
        *rest, F.lit(0.0).alias("identity_context_sentiment"), *[made[c] for c in counts],
        (F.col("_made.identity_term_count") > 0).alias("has_identity_terms"),
        *[made[c] for c in columns if c not in counts],
    )
